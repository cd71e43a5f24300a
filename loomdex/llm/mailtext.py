"""Mail bodies to the lines their sender wrote for this mail.

Bodies are exploded to normalised lines. Across mails, the messages of a thread are ranked by date and only the first-authored occurrence of a
line is kept; closing lines that recur in a sender's messages are signature. The form of lines (quote mark, introduction of a
quote, forward header, closing formula, delimiter, notice, footer, armour ...) gives each line a kind, and windows over the
lines of a mail turn kinds into regions: the prior of both rules, and the verdict where a mail's originals or siblings are not at hand.

Only hashes, lengths and kinds are shuffled, never the text. Windows are per mail, or cut off on the map side; everything else across
mails is pre-aggregated, so neither a sender nor a thread holding a third of all lines gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.session import cut

# Formulas and markers of mail programs, by language.
CLOSINGS = (
    "cheers", "regards", "kind regards", "best regards", "warm regards", "best wishes", "all the best", "best", "yours", "yours sincerely", "sincerely",
    "thanks", "thanks again", "many thanks", "thank you", "take care", "greetings from [^.]{1,30}", "ciao", "rgds", "br",
    "gruß", "gruss", "grüße", "viele grüße", "liebe grüße", "beste grüße", "mit freundlichen grüßen", "mfg", "lg", "danke",
    "saludos", "un saludo", "saludos cordiales", "un abrazo", "atentamente", "gracias",
    "cordialement", "bien cordialement", "amicalement", "bien à vous", "merci", "salutations", "cordiali saluti", "atenciosamente", "abraços",
)
_QUOTE = r"^ {0,2}(?:>|\|(?: |$)|\p{Lu}{1,3}>)"
_SAYS = r"(?:wrote|writes|schrieb(?: [^:]+)?|a écrit|escribió|ha scritto|scrisse|schreef|escreveu|skrev)"
_DATED = rf"(?u)^(?:On|Am|Le|El|Il|Op|Em|Den|At) [^:]*\d.*{_SAYS} ?:$"
_LEAD = r"(?u)^(?:On|Am|Le|El|Il|Op|Em|Den|At) .*\d"
_ENDS = rf"(?u)^.*\b{_SAYS} ?:$"
_NAMED = r"(?u)^(?:[\p{Lu}\"].+ writes:|(?:Quoting|Citando|Zitat von) .+:|\* .+ \[[\d:. /-]+\]:)$"
_FORWARD = r"(?iu)^(?:-{2,} ?(?:original message|forwarded message|forwarded by .+|ursprüngliche nachricht|weitergeleitete nachricht|message d'origine|message original|message transféré|mensaje original|mensaje reenviado|messaggio originale) ?-{2,}|begin forwarded message:)$"
_HEADER = r"(?iu)^(?:from|sent|date|to|cc|subject|von|gesendet|datum|an|betreff|de|envoyé|à|objet|enviado|para|asunto|fecha|reply-to|message-id): ?.*$"
_FROM = r"(?iu)^(?:from|von|de): .*<[^<>@ ]+@[^<>@ ]+>$"
_SLOGAN = r"(?iu)^(?:sent from my |sent from |sent with |sent via |get .{1,30} for |gesendet von |von meinem .{1,40} gesendet|envoyé d|enviado desde |inviato da|verzonden vanaf ).{0,60}$"
_NOTICE = r"(?iu)^(?:confidentiality notice|legal notice|disclaimer:|this (?:e-?mail|message)(?: and any (?:attachments?|files)| is (?:confidential|intended))|the information (?:in|contained in) this (?:e-?mail|message)|diese (?:e-?mail|nachricht) (?:enthält|ist) vertraulich|ce (?:message|courriel) (?:et|est) .{0,40}confidentiel|este (?:mensaje|correo) .{0,60}confidencial|please consider the environment).*$"
_SIGN = r"(?u)^(?:[~/—–-]|- |— |– |/ |~ )\p{L}[\p{L}.'’-]{0,30}(?: \p{L}[\p{L}.'’-]{0,30})?$"
_SENTENCE = r"(?u)(?:[\p{L}\p{N})`]{2,}[.!?:;]|\?)$"

#: Words from which a line is long enough to be recognised in another message.
LONG_WORDS = 5
#: Slices of lines for each input split; the size of a task, not a cap on anything.
SLICES = 4


def _kind(t: Column) -> Column:
    closing = rf"(?iu)^(?:{'|'.join(CLOSINGS)})[,!.]?$"
    forms = [
        ("blank", "^$"), ("quote", _QUOTE), ("footer2", r"(?iu)^\S+ mailing list$"), ("manage", r"(?iu)^(?:manage at|unsubscribe:?|to unsubscribe.{0,40}|list info:?) ?https?://\S+$|^https?://\S+/(?:mailman|listinfo)\S*$"),
        ("armour", r"^-----BEGIN PGP SIGNED MESSAGE-----$"), ("sealed", r"^-----BEGIN PGP (?:SIGNATURE|MESSAGE|PUBLIC KEY BLOCK)-----$"), ("unsealed", r"^-----END PGP [A-Z ]+-----$"), ("hash", r"^Hash: [\w, -]+$"),
        ("rule", r"^_{10,}$"), ("forward", _FORWARD), ("dated", _DATED), ("named", _NAMED), ("ends", _ENDS), ("lead", _LEAD), ("from", _FROM), ("ps", r"(?iu)^p\.? ?p?\.? ?s\.?[:. ].*$"),
        ("snip", r"(?iu)^(?:\[\s*(?:snip(?:ped)?|\.{3}|…|cut|quoted text (?:hidden|trimmed))\s*\]|<\s*snip(?:ped)?\s*>|[-*~]{2,} ?snip ?[-*~]{2,})$"), ("slogan", _SLOGAN), ("notice", _NOTICE), ("closing", closing), ("delimiter", r"^(?:--|-|—|–)$"), ("sign", _SIGN), ("header", _HEADER),
    ]
    out = F.when(t.rlike(forms[0][1]), forms[0][0])
    for name, pattern in forms[1:]:
        # Introductions end with a colon: a cheap test before the costly patterns.
        out = out.when(t.endswith(":") & t.rlike(pattern) if name in ("dated", "named", "ends") else t.rlike(pattern), name)
    return out.otherwise("text")


def explode_lines(mails: DataFrame, *carried: str) -> DataFrame:
    """One row per line: (src_table, src_key, *carried, line_no, kind, h, words, short); h hashes the line without quote marks, case and spacing."""
    own = ["src_table", "src_key", *carried]
    rows = mails.select(*own, F.posexplode(F.split("body", "\r?\n")).alias("pos", "line"))
    rows = rows.select(*own, (F.col("pos") + 1).cast("bigint").alias("line_no"), F.regexp_replace("line", r"[\s ]+$", "").alias("t"))
    bare = F.regexp_replace(F.lower("t"), r"^(?:\s*(?:>|\|))+\s*", "")
    short = ~F.col("t").rlike(_SENTENCE) & ((F.length("t") <= 38) | (F.size(F.split("t", " ")) <= 6))
    # A generator between the texts and the flags keeps later filters from repeating every pattern.
    flags = F.struct(_kind(F.col("t")).alias("kind"), F.xxhash64(bare).alias("h"), F.size(F.split(bare, " ")).alias("words"), short.alias("short"))
    return rows.select(*own, "line_no", F.explode_outer(F.array(flags)).alias("f")).select(*own, "line_no", "f.*")


def _regions(lines: DataFrame) -> DataFrame:
    """Adds ``part``: text (perhaps new), or why a line is not new."""
    mail = Window.partitionBy("src_table", "src_key").orderBy("line_no")
    past = mail.rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("kind")
    is_ = lambda *names: kind.isin(*names)
    rows = lines.withColumns({"prev": F.lag("kind").over(mail), "next": F.lead("kind").over(mail), "next2": F.lead("kind", 2).over(mail), "next_short": F.lead("short").over(mail)})
    prev, nxt = F.col("prev"), F.col("next")
    # Introductions of quotes; undated ones, and those broken over two lines, need their other half.
    intro = is_("dated") | (is_("named") & (nxt.isin("quote", "snip") | nxt.isNull())) | (is_("lead") & nxt.isin("ends")) | (is_("ends") & prev.isin("lead"))
    # Unmarked history: forward markers and bare header blocks hold to the end of the mail.
    starts = (is_("forward") & ~nxt.isin("dated", "lead", "named")) | (is_("rule") & nxt.isin("from")) | (is_("from") & nxt.isin("header"))
    footer = (is_("rule") & nxt.isin("footer2")) | (is_("footer2") & nxt.isin("manage"))
    para = F.sum(F.when(~is_("blank") & (prev.isNull() | prev.isin("blank")), 1).otherwise(0)).over(past)
    rows = rows.withColumns({"intro": intro, "para": para, "start": starts, "foot": footer})
    breaks = is_("quote", "ps", "slogan", "notice", "forward", "sealed", "unsealed", "snip") | F.col("intro") | F.col("foot") | F.col("start")
    opens = is_("closing", "delimiter") | (is_("sign") & (prev.isNull() | ~prev.isin("text")) & (nxt.isNull() | ~nxt.isin("text")))
    # Paragraphs of short lines only can be names and contact lines.
    inside = Window.partitionBy("src_table", "src_key", "para")
    rows = rows.withColumn("low", F.min(F.when(~is_("blank"), F.col("short") | is_("closing", "delimiter", "sign", "rule", "footer2", "manage"))).over(inside))
    rows = rows.withColumn("breaks", breaks)
    last = lambda flag, value: F.last(F.when(flag, value), ignorenulls=True).over(past)
    rows = rows.withColumns(
        {
            "fwd": F.max(F.col("start").cast("int")).over(past),
            # After an introduction without marked lines behind it, history may be unmarked.
            "bare": last(F.col("intro") | is_("quote", "snip"), F.when(F.col("intro"), 1).otherwise(0)),
            "footed": F.max(F.col("foot").cast("int")).over(past),
            "seal": last(is_("sealed", "unsealed"), kind),
            "head": last(is_("armour"), F.col("para")),
            "notice": last(is_("notice") | is_("blank") | F.col("breaks"), F.when(is_("notice"), 1).otherwise(0)),
            "sig": last(opens | F.col("breaks"), F.when(opens & ~F.col("breaks"), F.struct("para", nxt.alias("next"), "next_short"))
                        .otherwise(F.struct(F.lit(-9).cast("bigint").alias("para"), F.lit(None).cast("string").alias("next"), F.lit(None).cast("boolean").alias("next_short")))),
        }
    )
    gap = F.col("para") - F.col("sig.para")
    follows = F.col("sig.next")
    # Next to an opener: the rest of its paragraph if that goes on with a short line; after a blank line the next low paragraph.
    signed = ((gap == 0) & (follows.isNull() | follows.isin("blank") | F.coalesce(F.col("sig.next_short"), F.lit(True)))) | ((gap == 1) & follows.isin("blank") & F.col("low"))
    lonely = opens & follows.isin("blank")
    ahead = F.first(F.when(~is_("blank"), F.struct("low", "breaks")), ignorenulls=True).over(mail.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("ahead", ahead)
    # A formula alone before a full paragraph is part of the text ("Thanks!" as a greeting).
    greets = is_("closing") & lonely & F.col("ahead").isNotNull() & ~F.col("ahead.low") & ~F.col("ahead.breaks")
    part = (
        F.when(is_("blank"), "blank")
        .when(F.col("footed") == 1, "footer")
        .when((F.col("seal") == "sealed") | is_("sealed", "unsealed", "armour"), "armour")
        .when(is_("hash") & (F.col("head") == F.col("para")), "armour")
        .when(F.col("fwd") == 1, "history")
        .when(is_("quote", "snip") | F.col("intro") | is_("forward"), "history")
        .when(is_("rule"), "footer")
        .when(is_("slogan") & (prev.isNull() | ~prev.isin("text") | signed), "slogan")
        .when(F.col("notice") == 1, "notice")
        .when(signed & ~greets & ~is_("ps"), "signature")
        .otherwise("text")
    )
    return rows.withColumn("part", part).drop("prev", "next", "next2", "next_short", "intro", "start", "foot", "breaks", "fwd", "footed", "seal", "head", "notice", "sig", "ahead")


def _person(sender: Column) -> Column:
    """The name of a sender in one form: without address, list mark and company, given name first."""
    name = F.regexp_replace(F.lower(sender), r"<[^>]*>|\([^)]*\)|\"| via .*$", " ")
    name = F.trim(F.regexp_replace(name, r"\s+", " "))
    turned = F.trim(F.concat(F.substring_index(name, ",", -1), F.lit(" "), F.substring_index(name, ",", 1)))
    return F.nullif(F.when(name.contains(","), turned).otherwise(name), F.lit(""))


def new_text(mails: DataFrame, *, recurrences: int = 3, share: float = 0.1, splits: int | None = None) -> DataFrame:
    """Every line with ``part`` and the ``rule`` that decided: (src_table, src_key, line_no, part, rule); lines with part ``text`` are the new ones.

    ``mails``: src_table, src_key, message (identity; copies of one message share it), thread, sender, sent_us, body. Other parts:
    blank, history, signature, slogan, notice, footer, armour. Rules, the first that applies:

    * ``thread``: a line of LONG_WORDS words or more that an earlier message of the thread authored, that is, holds unmarked, is history where it is
      marked as a quote, stands in a forwarded part, or below an introduction without marked lines. A mail that repeats
      lines of an earlier one without any such sign is taken for an edited re-send, which keeps its text;
    * ``recurrence``: a line of the last two paragraphs of a sender's own part, of any length and form, that closes ``recurrences`` of that sender's messages or
      more and at least ``share`` of them, is signature;
    * ``form``: what the form of lines says, for messages whose originals or siblings are not in the collection.

    ``splits``: input splits of ``mails``, where they are known; asking ``mails`` runs its exchanges once more.
    Null bodies have no lines, an empty body has one blank line; null thread or sender: the cross-mail rules are not applied; null sent_us ranks
    last in its thread; repeated mails share their message, so neither is the other's history; bodies of any length are used whole.
    """
    name = _person(F.col("sender"))
    carried = {"message": F.xxhash64("message"), "thread": F.when(F.col("thread").isNotNull(), F.xxhash64("thread")), "sender": F.when(name.isNotNull(), F.xxhash64(name)), "sent_us": F.coalesce("sent_us", F.lit(2**62))}
    # Slices in proportion to the input, so that tasks keep their size when the collection grows.
    splits, cores = splits or mails.rdd.getNumPartitions(), mails.sparkSession.sparkContext.defaultParallelism
    slices = SLICES * splits if splits > cores else cores
    lines = explode_lines(mails.withColumns(carried), *carried).repartition(slices, "src_table", "src_key")
    mail = Window.partitionBy("src_table", "src_key")
    # Closing lines: the last two paragraphs of the sender's own part, if they are not its first.
    rows = _regions(lines)
    own = F.when(~F.col("part").isin("history", "footer", "armour", "blank"), F.col("para"))
    rows = rows.withColumns({"ends": F.max(own).over(mail), "begins": F.min(own).over(mail)})
    closing = own.isNotNull() & (F.col("para") >= F.col("ends") - 1) & (F.col("para") > F.col("begins")) & F.col("sender").isNotNull()
    long = (F.col("words") >= LONG_WORDS) & F.col("thread").isNotNull()
    signed = (F.col("kind") == "quote") | ((F.col("part") == "history") & (F.col("kind") == "text")) | ((F.col("part") == "text") & F.coalesce(F.col("bare") == 1, F.lit(False)))
    rows = rows.withColumns({"closing": F.coalesce(closing, F.lit(False)), "quoted": F.coalesce(long & signed, F.lit(False)), "authored": F.coalesce(long & (F.col("part") == "text"), F.lit(False))})
    # The regions are worked out once; what the cross-mail rules need is kept for the lines that they look at.
    seen = F.struct("h", "message", "thread", "sender", "sent_us", "closing", "quoted", "authored")
    rows = cut(rows.select("src_table", "src_key", "line_no", "part", F.when(F.col("closing") | F.col("quoted") | F.col("authored") | (F.col("line_no") == 1), seen).alias("x")))
    line_of = ["src_table", "src_key", "line_no", "x.*"]
    # Thread messages are ranked by date: the first that authored a line. The rank is cut off on the map side, so a line that a third of all messages hold is no hot group.
    rank = Window.partitionBy("thread", "h").orderBy("sent_us", "message")
    first = rows.where("x.authored").select("x.thread", "x.h", "x.sent_us", "x.message").withColumn("r", F.row_number().over(rank)).where("r = 1").select("thread", "h", F.struct("sent_us", "message").alias("f"))
    later = (F.col("f.message") != F.col("message")) & (F.col("f") < F.struct("sent_us", "message"))
    old = rows.where("x.quoted").select(*line_of).join(first, ["thread", "h"]).where(later).select("src_table", "src_key", "line_no", F.lit("history").alias("verdict"), F.lit("thread").alias("why"))
    # Closing lines that recur in a sender's messages.
    ends = rows.where("x.closing").select(*line_of)
    # A sender's messages are counted by the mails' first lines: every mail has one.
    sent = rows.where("line_no = 1 and x.sender is not null").groupBy("x.sender").agg(F.count_distinct("x.message").alias("total"))
    again = ends.groupBy("sender", "h").agg(F.count_distinct("message").alias("n")).where(F.col("n") >= recurrences).join(sent, "sender").where(F.col("n") >= share * F.col("total")).select("sender", "h")
    mine = ends.join(again, ["sender", "h"], "left_semi").select("src_table", "src_key", "line_no", F.lit("signature").alias("verdict"), F.lit("recurrence").alias("why"))
    verdicts = old.unionByName(mine).groupBy("src_table", "src_key", "line_no").agg(F.min(F.struct("verdict", "why")).alias("v"))
    out = rows.select("src_table", "src_key", "line_no", "part").join(verdicts, ["src_table", "src_key", "line_no"], "left")
    # Notices and slogans that recur keep their finer name.
    part = F.when(F.col("part").isin("notice", "slogan") & (F.col("v.why") == "recurrence"), F.col("part")).otherwise(F.coalesce("v.verdict", "part"))
    return out.select("src_table", "src_key", "line_no", part.alias("part"), F.coalesce("v.why", F.lit("form")).alias("rule"))
