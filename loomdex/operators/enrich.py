"""Enrichment: cross-references and concept tags of document bodies, each in a single projection and one explode."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reference patterns, in the order in which edges are numbered.
_FIXES = r"(?iU)(?:fix(?:es|ed)?|clos(?:es|ed)?|resolv(?:es|ed)?)\s+#(\d+)"
_ISSUE = r"(?U)(?:^|[^&\w])#(\d+)"
_CROSS = r"(?U)(\w[\w.-]*/\w[\w.-]*)#(\d+)"
_SHA = r"(?U)(?:^|[\s(,])([0-9a-f]{7,40})\b"
_SPECS = (("references_bip", "BIP", r"(?iU)\bBIP[- ]?(\d{1,4})\b"), ("references_bolt", "BOLT", r"(?iU)\bBOLT[- ]?(\d{1,2})\b"), ("references_blip", "bLIP", r"(?iU)\bbLIP[- ]?(\d{1,4})\b"),
          ("references_lud", "LUD", r"(?iU)\bLUD[- ]?(\d{1,2})\b"), ("references_nut", "NUT", r"(?iU)\bNUT[- ]?(\d{1,2})\b"))

# The default vocabulary, (slug, name, category, aliases).
VOCABULARY = (
    ("taproot", "Taproot", "soft-fork", "taproot, bip-340, bip-341, bip-342, bip340, bip341, bip342, schnorr"),
    ("segwit", "Segregated Witness", "soft-fork", "segwit, segregated witness, bip-141, bip-143, bip-144, bip141"),
    ("op-cat", "OP_CAT", "soft-fork", "op_cat, op cat, bip-347, bip347"),
    ("op-checktemplateverify", "OP_CHECKTEMPLATEVERIFY", "soft-fork", "op_checktemplateverify, op_ctv, ctv, bip-119, bip119, checktemplateverify"),
    ("op-checksigfromstack", "OP_CHECKSIGFROMSTACK", "soft-fork", "op_checksigfromstack, op_csfs, csfs, checksigfromstack"),
    ("covenants", "Covenants", "soft-fork", "covenant, covenants"),
    ("miniscript", "Miniscript", "scripting", "miniscript, mini script"),
    ("descriptors", "Output Script Descriptors", "scripting", "descriptor, descriptors, output descriptor, output descriptors"),
    ("psbt", "Partially Signed Bitcoin Transactions", "transaction", "psbt, bip-174, bip174, partially signed"),
    ("rbf", "Replace-By-Fee", "transaction", "replace-by-fee, replace by fee, rbf, bip-125, bip125"),
    ("cpfp", "Child Pays for Parent", "transaction", "cpfp, child pays for parent, child-pays-for-parent"),
    ("package-relay", "Package Relay", "transaction", "package relay, package-relay"),
    ("cluster-mempool", "Cluster Mempool", "mempool", "cluster mempool, cluster-mempool"),
    ("v3-transactions", "v3 Transactions", "transaction", "v3 transaction, v3 transactions, topologically restricted until confirmation, truc"),
    ("ephemeral-anchors", "Ephemeral Anchors", "transaction", "ephemeral anchor, ephemeral anchors, ephemeral-anchors"),
    ("lightning", "Lightning Network", "lightning", "lightning network, lightning"),
    ("htlc", "Hash Time-Locked Contract", "lightning", "htlc, hash time-locked contract, hash time locked contract"),
    ("ptlc", "Point Time-Locked Contract", "lightning", "ptlc, point time-locked contract"),
    ("channel-splicing", "Channel Splicing", "lightning", "splicing, splice, splice-in, splice-out, channel splicing"),
    ("anchor-outputs", "Anchor Outputs", "lightning", "anchor output, anchor outputs, anchor channels, anchor-outputs"),
    ("bolt11", "BOLT11 Invoices", "lightning", "bolt11, bolt-11, bolt 11, lightning invoice"),
    ("bolt12", "BOLT12 Offers", "lightning", "bolt12, bolt-12, bolt 12, offers, lightning offers"),
    ("onion-messages", "Onion Messages", "lightning", "onion message, onion messages, onion-messages"),
    ("blinded-paths", "Blinded Paths", "lightning", "blinded path, blinded paths, blinded-paths, route blinding"),
    ("dual-funding", "Dual Funding", "lightning", "dual funding, dual-funding, interactive-tx"),
    ("async-payments", "Async Payments", "lightning", "async payment, async payments, asynchronous payment, async-payments"),
    ("trampoline-routing", "Trampoline Routing", "lightning", "trampoline, trampoline routing, trampoline-routing"),
    ("channel-jamming", "Channel Jamming", "lightning", "channel jamming, channel-jamming, jamming"),
    ("payjoin", "Payjoin", "privacy", "payjoin, pay-join, bip-78, bip78, p2ep"),
    ("silent-payments", "Silent Payments", "privacy", "silent payment, silent payments, bip-352, bip352"),
    ("coinswap", "Coinswap", "privacy", "coinswap, coin swap"),
    ("musig2", "MuSig2", "cryptography", "musig, musig2, multi-signature, multisig"),
    ("frost", "FROST", "cryptography", "frost, flexible round-optimized schnorr threshold"),
    ("bip32", "HD Wallets", "wallet", "bip32, bip-32, hierarchical deterministic, hd wallet"),
    ("erlay", "Erlay", "p2p", "erlay"),
    ("compact-block-filters", "Compact Block Filters", "p2p", "compact block filter, compact block filters, bip-157, bip-158, bip157, bip158, neutrino"),
    ("assumeutxo", "AssumeUTXO", "validation", "assumeutxo, assume utxo, assume-utxo"),
    ("keysend", "Keysend", "lightning", "keysend, spontaneous payment, spontaneous payments"),
    ("watchtower", "Watchtowers", "lightning", "watchtower, watchtowers, breach remedy"),
    ("eltoo", "Eltoo", "lightning", "eltoo, sighash_anyprevout, anyprevout, bip-118, bip118"),
    ("lsp", "Lightning Service Provider", "lightning", "lsp, lightning service provider, lsps"),
    ("channel-factory", "Channel Factories", "lightning", "channel factory, channel factories, joinpool, joinpools"),
    ("timelock", "Timelocks", "scripting", "timelock, timelocks, cltv, csv, bip-65, bip65, bip-112, bip112, checklocktimeverify, checksequenceverify"),
    ("vaults", "Vaults", "scripting", "vault, vaults, bitcoin vault, bitcoin vaults"),
    ("lnurl", "LNURL", "protocols", "lnurl, lnurl-pay, lnurl-withdraw, lnurl-auth, lnurl-channel"),
    ("ecash", "Ecash", "protocols", "ecash, e-cash, cashu, chaumian"),
    ("dlc", "Discreet Log Contracts", "protocols", "dlc, discreet log contract, discreet log contracts"),
    ("submarine-swap", "Submarine Swaps", "protocols", "submarine swap, submarine swaps, atomic swap, atomic swaps"),
    ("nostr", "Nostr", "protocols", "nostr, nip"),
    ("coin-selection", "Coin Selection", "wallet", "coin selection, coin-selection, utxo selection"),
    ("codex32", "Codex32", "wallet", "codex32, bip-93, bip93"),
    ("threshold-signature", "Threshold Signatures", "cryptography", "threshold signature, threshold signatures, tss"),
)


def vocabulary(rows=VOCABULARY) -> list[tuple[str, list[str]]]:
    """[(slug, aliases)] of vocabulary rows."""
    return [(slug, [a.strip() for a in aliases.split(",")]) for slug, _, _, aliases in rows]


def _edge(ord_: int, ref_type: str, ext: Column, context: Column) -> Column:
    return F.struct(F.lit(ord_).alias("ord"), F.lit(ref_type).alias("ref_type"), ext.alias("to_external"), context.alias("context"))


def extract_references(documents: DataFrame, *, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(from_doc_id, ord, pos, ref_type, to_external, context): one row per match in ``body``, in edge order.

    ``documents``: id, body, source_repo. Titles are not read; a null body gives no rows. ``fixes`` edges also appear as mentions; a qualified mention of the
    document's own repository gives nothing; numbers are kept as written. ``kinds`` limits the reference types.
    """
    body, repo = F.col("body"), F.coalesce(F.col("source_repo"), F.lit(""))
    own = lambda m: F.concat(repo, F.lit("#"), F.regexp_extract(m, r"#(\d+)", 1))
    parts = [
        (_FIXES, lambda m: _edge(0, "fixes", own(m), m), None),
        (_ISSUE, lambda m: _edge(1, "mentions_issue", own(m), F.trim(F.regexp_replace(m, r"^[\s]+", ""))), None),
        (_CROSS, lambda m: _edge(2, "mentions_issue", m, m), lambda e: F.substring_index(e["to_external"], "#", 1) != repo),
    ]

    def numbered(i: int, kind: str, prefix: str):
        return lambda m: _edge(3 + i, kind, F.concat(F.lit(f"{prefix}-"), F.regexp_extract(m, r"(\d+)", 1)), m)

    parts += [(pattern, numbered(i, kind, prefix), None) for i, (kind, prefix, pattern) in enumerate(_SPECS)]
    sha = lambda m: F.regexp_extract(m, r"([0-9a-f]{7,40})", 1)
    parts.append((_SHA, lambda m: _edge(8, "references_commit", sha(m), F.regexp_replace(m, r"^\s+", "")), lambda e: e["to_external"].rlike("[0-9]") & e["to_external"].rlike("[a-f]")))
    arrays = []
    for pattern, make, keep in parts:
        a = F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), make)
        arrays.append(F.filter(a, keep) if keep else a)
    edges = documents.where(F.col("body").isNotNull()).select(F.col("id").alias("from_doc_id"), F.posexplode(F.concat(*arrays)).alias("pos", "e"))
    out = edges.select("from_doc_id", F.col("e.ord").alias("ord"), "pos", F.col("e.ref_type").alias("ref_type"), F.col("e.to_external").alias("to_external"), F.col("e.context").alias("context"))
    return out.where(F.col("ref_type").isin(*kinds)) if kinds else out


def alias_pattern(aliases: list[str]) -> str:
    return r"(?iU)\b(?:" + "|".join(re.sub(r"([^\w\s-])", r"\\\1", a) for a in aliases) + r")\b"


def tag_concepts(documents: DataFrame, words: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """(doc_id, concept_slug, confidence): one row per document and concept of which some alias stands in the body as a whole word.

    The vocabulary is a parameter of fixed size; each concept is one pattern, compiled once per task. Null bodies give no rows.
    """
    # Lower-cased once behind a generator; a plain substring test spares most texts the pattern.
    rows = documents.where(F.col("body").isNotNull()).select(F.col("id").alias("doc_id"), F.explode_outer(F.array(F.lower("body"))).alias("t"))
    hits = []
    for slug, aliases in words or vocabulary():
        maybe = F.lit(False)
        for a in aliases:
            if not any(b != a and b in a for b in aliases):
                maybe = maybe | F.col("t").contains(a)
        hits.append(F.when(maybe & F.col("t").rlike(alias_pattern(aliases)), F.lit(slug)))
    rows = rows.select("doc_id", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("concept_slug"))
    return rows.withColumn("confidence", F.lit(1.0).cast("float"))


def resolve_references(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """``refs`` with ``to_doc_id`` filled from ``repo#N`` where an issue or pull request of that name is stored."""
    ids = documents.where(F.col("source_type").isin("github_issue", "github_pr")).groupBy(F.concat("source_repo", F.lit("#"), "source_id").alias("to_external")).agg(F.min("id").alias("_id"))
    return refs.join(ids, "to_external", "left").withColumn("to_doc_id", F.coalesce("to_doc_id", "_id")).select(*refs.columns)
