"""Variant spellings of names: linking all spellings of one person or organisation.

Each distinct spelling is parsed once (mail forms, logins, reordered parts, initials, titles, nicknames, company words) to a *core*:
(given name, surname) of a person or (kind, proper name) of an organisation. Variant cores meet through a pigeonhole segment join: k
edits, k by the length of the part, leave one of its segments intact, so the substrings of a core at shifted positions are looked
up in an inverted index of the segments of given name and surname, and a banded edit distance decides. Names written apart or
the other way round, or without a middle name, meet by their letters. Initials and logins then attach to the one core they
can stand for; what could stand for several is left alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.session import cut

# Short forms of given names; a form may belong to several.
NICKNAMES = {
    "alexander": "alex sasha xander alec", "alexandra": "alex sasha alexa", "andrea": "andi andy", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny",
    "charles": "chuck charlie", "christina": "chris tina chrissy", "christopher": "chris kit topher", "daniel": "dan danny", "daniela": "dani", "david": "dave", "deborah": "debbie deb",
    "dorothea": "thea dora dorothy", "edward": "ned ed eddie ted", "elizabeth": "liz beth lizzie betty eliza", "frederic": "fred freddy", "gabriela": "gabi gaby", "james": "jim jimmy", "jennifer": "jen jenny",
    "johanna": "hanna jo", "john": "jack johnny", "jonathan": "jon jonny", "joseph": "joe joey", "katherine": "kate kathy katie kat", "leonard": "leo lenny", "leonora": "nora leo", "margaret": "peggy maggie meg greta",
    "marta": "martha", "martin": "marty", "muhammad": "mohamed mohammed muhammed mohammad mohamad", "matthias": "matz matt", "matthew": "matt", "maximilian": "max", "michael": "mike mick", "nicolas": "nico nick", "nicholas": "nick", "patricia": "trish pat patty",
    "philippa": "pippa", "rebecca": "becky becca", "richard": "dick rick", "robert": "bob rob bobby", "samantha": "sam", "samuel": "sam sammy", "stefan": "steff", "stephen": "steve", "theodore": "ted theo teddy",
    "thomas": "tom tommy", "victoria": "vicky vic tori", "wilhelmina": "mina willa", "william": "bill will billy", "zacharias": "zack zach",
}
#: Endings of short and pet forms, after the first letters of the name.
DIMINUTIVES = ("ushka", "uschka", "uska", "usia", "inka", "inho", "inha", "chen", "ito", "ita", "ino", "ina", "ette", "ie", "y", "i", "ka")
# Words of organisations and their short forms; legal forms; names that are nobody's.
ORG_WORDS = {
    "labs": "labs", "lab": "labs", "laboratories": "labs", "laboratory": "labs", "foundation": "foundation", "fdn": "foundation", "found": "foundation", "institute": "institute", "inst": "institute",
    "research": "research", "rsch": "research", "res": "research", "security": "security", "sec": "security", "systems": "systems", "sys": "systems", "system": "systems", "works": "works", "wks": "works",
    "collective": "collective", "coll": "collective", "group": "group", "grp": "group", "company": "company", "co": "company", "university": "university", "univ": "university", "technologies": "technologies", "tech": "technologies",
}
LEGAL = frozenset("inc ltd llc gmbh ag corp plc sa bv oy the limited incorporated corporation".split())
NOBODY = frozenset("ghost unknown anonymous anon nobody none null nan n/a na - -- ? deleted root admin administrator user guest noreply no-reply invalid system webmaster postmaster moderator someone test".split())
_BOT = re.compile(r"(?:^|[-_ .\[])bots?\]?$|^bots?[-_]|\[bot\]|bot$(?<=-bot)|^(?:dependabot|renovate|github-actions)", re.I)
_MAIL = re.compile(r'^\s*"?\s*([^"<>]*?)\s*"?\s*<\s*([^<>@\s]*)@?([^<>]*)>\s*$')
_TITLES = frozenset("dr prof mr mrs ms mx sir ing jr sr phd md".split())
_OWN = {v: k for k, vs in NICKNAMES.items() for v in vs.split()}


def fold(s: str) -> str:
    """Lower case without accents; letters that do not decompose are spelled out."""
    s = unicodedata.normalize("NFKD", s.casefold().replace("ø", "o").replace("æ", "ae").replace("ł", "l").replace("đ", "d").replace("ı", "i"))
    return "".join(c for c in s if not unicodedata.combining(c))


def given_options(g: str) -> list[str]:
    """The given names that a folded given name may stand for."""
    if g in NICKNAMES:
        return [g]
    found = [k for k, v in NICKNAMES.items() if g in v.split()]
    for ending in DIMINUTIVES if not found else ():
        stem = g.removesuffix(ending)
        if stem != g and len(stem) >= 4:
            found = [k for k in NICKNAMES if k.startswith(stem)]
            if found:
                break
    return found or [g]


def parse(author: str | None) -> tuple[str, str | None, list[str] | None, str | None, str | None]:
    """(kind, first, options, last, fused). kind: person (first = given name as typed, options = names it may stand for, last = surname), org
    (first = kind of organisation, last = proper name), short (first = initial, last = surname), login (fused), none."""
    none = ("none", None, None, None, None)
    if author is None:
        return none
    text = unicodedata.normalize("NFKC", author)
    text = re.sub(r"\s+", " ", text).strip()
    m = _MAIL.match(text)
    local = ""
    if m:
        text, local = m.group(1).strip(), m.group(2)
        if not text:
            text = local
    elif re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", text):
        text = text.split("@")[0]
    text = re.sub(r"\s+via\s+\S.*$", "", text, flags=re.I)
    text = re.sub(r"\s*\([^)]*\)\s*$", "", text).strip(" \"'")
    plain = fold(text)
    if not plain or plain in NOBODY or _BOT.search(plain) or not re.search(r"[^\W\d_]", plain):
        return none
    if " " not in plain and "," not in plain:
        parts = [p for p in re.split(r"[-_.]", plain) if p]
        if len(parts) >= 2 and parts[-1] in ORG_WORDS:
            return ("org", ORG_WORDS[parts[-1]], None, "-".join(parts[:-1]), None)
        if len(parts) == 2 and (parts[0] in NICKNAMES or given_options(parts[0]) != [parts[0]]) and len(parts[1]) > 2:
            return ("person", parts[0], given_options(parts[0]), parts[1], None)
        return ("login", None, None, None, re.sub(r"[^a-z0-9]", "", plain))
    words = [w for w in re.split(r"[\s,]+", re.sub(r"(?<=\w)\.(?=\w)", ". ", plain)) if w]
    bare = [w.strip(".") for w in words]
    org = [w for w in bare if w not in LEGAL]
    if len(org) >= 3 and org[-1] in ("group", "grp") and org[-2] in ORG_WORDS:
        org = org[:-1]
    if len(org) >= 2 and org[-1] in ORG_WORDS and "," not in plain.rstrip("., incltd"):
        return ("org", ORG_WORDS[org[-1]], None, "-".join(org[:-1]), None)
    if len(org) >= 3 and org[0] in ORG_WORDS and org[1] == "of":
        return ("org", ORG_WORDS[org[0]], None, "-".join(org[2:]), None)
    if len(org) >= 2 and len(org) < len(bare) and org[-1] in ORG_WORDS:
        return ("org", ORG_WORDS[org[-1]], None, "-".join(org[:-1]), None)
    if "," in plain:
        last, _, first = plain.partition(",")
        words = [*first.split(), *last.split()] if first.strip() else last.split()
        words = [w for x in words for w in re.sub(r"(?<=\w)\.(?=\w)", ". ", x).split()]
    words = [w for w in words if w.strip(".") and w.strip(".") not in _TITLES]
    long = [w.strip(".") for w in words if len(w.strip(".")) > 1]
    initials = [w.strip(".") for w in words if len(w.strip(".")) == 1]
    if len(long) >= 2:
        return ("person", long[0], given_options(long[0]), "-".join(long[1:]), None)
    if len(long) == 1 and initials:
        return ("short", initials[0], None, long[0], None)
    return ("login", None, None, None, re.sub(r"[^a-z0-9]", "", plain)) if long else none


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
    for batch in batches:
        rows = [parse(a) for a in batch.column("author").to_pylist()]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([batch.column("author"), batch.column("n"), *columns], names=["author", "n", "kind", "first", "options", "last", "fused"])


def _swaps(a: Column) -> Column:
    """All forms of ``a`` with two neighbouring letters swapped."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(a.substr(F.lit(1), i - 1), a.substr(i + 1, F.lit(1)), a.substr(i, F.lit(1)), a.substr(i + 2, F.length(a))))


def _within(a: Column, b: Column, k: Column) -> Column:
    """At most ``k`` (0, 1 or 2) insertions, deletions, substitutions or swaps of neighbours: banded Levenshtein, then one swap and the band again."""
    d = F.levenshtein(a, b, 3)
    swapped = F.exists(_swaps(a), lambda x: F.levenshtein(x, b, 1).between(0, k - 1))
    return (a == b) | (d.between(1, k)) | ((k >= 1) & d.between(1, 3) & swapped)


#: Edits by length of a name part: none below 3 letters, one, two from LONG letters.
LONG = 9


def _k(length: Column, most: int = 2) -> Column:
    return F.when(length < 3, 0).when(length < LONG, 1).otherwise(most)


def _cut(name: Column, length: Column, j: Column, pieces: Column, shift: Column | int = 0) -> Column:
    start, stop = F.floor(length * j / pieces), F.floor(length * (j + 1) / pieces)
    return name.substr((start + 1 + shift).cast("int"), (stop - start).cast("int"))


# Of 2 k + 1 segments k edits leave one intact, because a swap across a border spoils two.
_PIECES = [(k, j) for k in (1, 2) for j in range(2 * k + 1)]
_PROBES = [(d, k, j, shift) for d in range(-2, 3) for k, j in _PIECES if abs(d) <= k for shift in sorted({0, -d} if k == 1 else {*range(min(0, -d) - 1, max(0, -d) + 2)})]


def _segments(name: Column, most: int = 2) -> Column:
    """What the index holds of a name: (length, piece, text) of its k + 1 (and k more) segments."""
    size, known = F.length(name), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(j).alias("j")) for k, j in _PIECES])
    return F.transform(F.filter(known, lambda c: c["k"] == _k(size, most)), lambda c: F.struct(size.alias("len"), c["j"].alias("j"), _cut(name, size, c["j"], 2 * c["k"] + 1).alias("seg")))


def _shifted(name: Column, most: int = 2) -> Column:
    """What a name looks up: its substrings at the places, shifted by up to k letters, where names of similar length have their segments."""
    size = F.length(name)
    known = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(k).alias("k"), F.lit(j).alias("j"), F.lit(shift).alias("shift")) for d, k, j, shift in _PROBES])
    fits = F.filter(known, lambda c: (c["k"] == _k(size + c["d"], most)) & (F.floor((size + c["d"]) * c["j"] / (2 * c["k"] + 1)) + c["shift"] >= 0))
    return F.array_distinct(F.transform(fits, lambda c: F.struct((size + c["d"]).alias("len"), c["j"].alias("j"), _cut(name, size + c["d"], c["j"], 2 * c["k"] + 1, c["shift"]).alias("seg"))))


def _met(cores: DataFrame, mode: str) -> DataFrame:
    """Candidate pairs of cores through the inverted index of segments: ``s``: equal given name and a segment of the surname; ``g``: the other way round;
    ``both``: a segment of each, one edit in each. So no key is as frequent as a given name or a surname alone."""
    side = {
        "s": lambda of: F.transform(f"{of}_s", lambda x: F.xxhash64(F.lit("s"), "kind", "g", x)),
        "g": lambda of: F.transform(f"{of}_g", lambda x: F.xxhash64(F.lit("g"), "kind", "s", x)),
        "both": lambda of: F.flatten(F.transform(f"{of}1_g", lambda x: F.transform(f"{of}1_s", lambda y: F.xxhash64("kind", x, y)))),
    }[mode]
    index = cores.select(F.explode(F.array_distinct(side("held"))).alias("h"), F.col("id").alias("id2"))
    probe = cores.select(F.explode(F.array_distinct(side("asked"))).alias("h"), "id")
    return probe.join(index, "h").where("id <> id2").select("id", "id2").distinct()


def _same_letters(cores: DataFrame) -> DataFrame:
    """Pairs of cores of one name written apart: blanks or hyphens elsewhere (exact 2), the parts the other way round, or a middle name left out (1)."""
    bare = lambda *c: F.regexp_replace(F.concat(*c), "[^\\p{L}\\p{N}]", "")
    fused = cores.select("kind", "id", bare("g", "s").alias("f"))
    turned = cores.select("kind", F.col("id").alias("id2"), bare("s", "g").alias("f"))
    people = cores.where("kind = 'person'")
    short = people.where(F.col("s").contains("-")).select("g", F.substring_index("s", "-", -1).alias("s"), "id")
    pairs = fused.join(fused.withColumnRenamed("id", "id2"), ["kind", "f"]).where("id <> id2").select("id", "id2", F.lit(2).alias("exact"))
    pairs = pairs.unionByName(fused.join(turned, ["kind", "f"]).where("id <> id2").select("id", "id2", F.lit(1).alias("exact")))
    middle = short.join(people.select("g", "s", F.col("id").alias("id2")), ["g", "s"]).select("id", "id2", F.lit(1).alias("exact"))
    both = pairs.unionByName(middle)
    return both.unionByName(both.select(F.col("id2").alias("id"), F.col("id").alias("id2"), "exact"))


def _misspelt(cores: DataFrame) -> DataFrame:
    """(kind, g, s, g2, s2): for cores that are variants of a better known core, that core.

    All cores are looked up, whatever their frequency. What is compared is whether the weaker one of a pair could stand for itself: a core written in one way
    only and backed by no initial or login, or clearly below its neighbour, is a variant; two cores that are each written in several ways are two
    people. ``weight`` counts what initials or a login say for a core as one spelling more. The better known one has more spellings, then more rows, then
    the smaller name, so there are no circles.
    """
    bearers = cores.groupBy("s").agg(F.count("*").alias("givens"))
    cores = cores.join(bearers, "s").withColumns({"weight": F.col("support") + F.col("backed"), "id": F.xxhash64("kind", "g", "s")})
    keyed = cut(cores.select("id", "kind", "g", "s", *[F.transform(f(F.col(c)), lambda x: F.xxhash64(x)).alias(f"{n}_{c}") for n, f in (("held", _segments), ("asked", _shifted), ("held1", lambda c: _segments(c, 1)), ("asked1", lambda c: _shifted(c, 1))) for c in ("g", "s")]))
    cores = cut(cores)
    met = _met(keyed, "s").unionByName(_met(keyed, "g")).unionByName(_met(keyed, "both")).withColumn("exact", F.lit(0))
    met = met.unionByName(_same_letters(cores)).groupBy("id", "id2").agg(F.max("exact").alias("exact"))
    other = cores.select(*[F.col(c).alias(f"{c}2") for c in ("id", "g", "s", "n", "support", "givens", "weight")])
    pairs = met.join(cores, "id").join(other, "id2")
    below = ((F.col("weight") * 3 <= F.col("weight2")) & (F.col("n") < F.col("n2"))) | ((F.col("weight") * 2 <= F.col("weight2")) & (F.col("n") * 8 <= F.col("n2")))
    listed = [*NICKNAMES, *_OWN]
    # An initial that fits both speaks for neither; of one surname, a given name that is no known one is a slip for one that is.
    initial = (F.col("s") == F.col("s2")) & (F.substring("g", 1, 1) == F.substring("g2", 1, 1))
    slip = (F.col("s") == F.col("s2")) & ~F.col("g").isin(listed) & F.col("g2").isin(listed) & (F.length("g") >= 4)
    weak = (F.col("weight") == 1) | below | (initial & (F.col("support") == 1)) | slip
    # Two names that both are known are two names, not one misspelt.
    named = (F.col("g") != F.col("g2")) & F.col("g").isin(listed) & F.col("g2").isin(listed) & (F.col("kind") == "person")
    kg, ks = _k(F.greatest(F.length("g"), F.length("g2"))), _k(F.greatest(F.length("s"), F.length("s2")))
    edited = _within(F.col("g"), F.col("g2"), F.when((F.col("s") == F.col("s2")) | (kg == 0), kg).otherwise(1)) & _within(F.col("s"), F.col("s2"), F.when((F.col("g") == F.col("g2")) | (ks == 0), ks).otherwise(1))
    # Short surnames and short given names have many real neighbours: a surname that others bear is real, and so is a given name of a few letters.
    short = F.least(F.length("s"), F.length("s2")) < 5
    real = short & (F.col("s") != F.col("s2")) & (F.col("givens") > 1)
    brief = (F.col("g") != F.col("g2")) & (F.least(F.length("g"), F.length("g2")) < 4) & ~below & (F.col("kind") == "person")
    near = cut(pairs.where((F.col("exact") > 0) | (edited & ~named & ~real & ~brief)).withColumn("weak", weak | (F.col("exact") == 2) | ((F.col("exact") == 1) & (F.col("support") == 1))))
    # Between equals the one with more neighbours is the form that the others vary.
    degree = near.groupBy("id").agg(F.count("*").alias("degree"))
    near = near.join(degree, "id").join(degree.select(F.col("id").alias("id2"), F.col("degree").alias("degree2")), "id2", "left")
    above = F.struct("support2", "weight2", "n2", F.coalesce("degree2", F.lit(0)), F.col("id2")) > F.struct("support", "weight", "n", "degree", F.col("id"))
    found = near.where(above & F.col("weak"))
    best = Window.partitionBy("kind", "g", "s").orderBy(F.desc("exact"), F.desc("support2"), F.desc("n2"), "g2", "s2")
    return found.withColumn("r", F.row_number().over(best)).where("r = 1").select("kind", "g", "s", "g2", "s2")


def _forms(g: Column, s: Column) -> Column:
    """Array of (form, strength): how the core may be written as one word."""
    nick = F.create_map(*[x for k, v in NICKNAMES.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v.split()]))])
    bare, i = F.regexp_replace(s, "[^a-z0-9]", ""), g.substr(1, 1)
    strong = F.array(F.concat(g, bare), F.concat(bare, g))
    strong = F.concat(strong, F.flatten(F.transform(F.coalesce(F.try_element_at(nick, g), F.array().cast("array<string>")), lambda n: F.array(F.concat(n, bare), F.concat(bare, n)))))
    each = lambda a, k: F.transform(a, lambda f: F.struct(f.alias("fused"), F.lit(k).alias("strength")))
    return F.concat(each(strong, 2), each(F.array(F.concat(i, bare), F.concat(bare, i)), 1))


def _spoken(kind: Column, g: Column, s: Column) -> Column:
    bare = F.regexp_replace(s, "[^a-z0-9]", "")
    person = F.concat(F.transform(_forms(g, s), lambda f: f["fused"]), F.array(F.concat(g.substr(1, 1), F.lit("."), s)))
    return F.when(kind == "org", F.array(F.concat(bare, g))).otherwise(person)


def entities(df: DataFrame, author: str = "author") -> DataFrame:
    """(author, entity): one row per distinct spelling that stands for somebody; equal entities are one person or organisation.

    Nulls, empty texts, placeholders and bots have no row. A form that could stand for several people (an initial or short name shared
    by two with one surname) is an entity of its own. Repeated rows count towards the support of a spelling only. An empty table gives an empty result.
    """
    spellings = df.where(F.col(author).isNotNull()).groupBy(F.col(author).alias("author")).agg(F.count("*").alias("n"))
    parsed = cut(spellings.mapInArrow(_parsed, "author string, n long, kind string, first string, options array<string>, last string, fused string").where("kind <> 'none'"))
    sure = parsed.where("kind = 'org' or (kind = 'person' and size(options) = 1)").select("author", "n", "kind", F.coalesce(F.get("options", F.lit(0)), "first").alias("g"), F.col("last").alias("s"))
    first_cores = sure.groupBy("kind", "g", "s").agg(F.sum("n").alias("n"), F.count("*").alias("support"))
    # A short form of several given names: the only one of them that has this surname.
    unsure = parsed.where("kind = 'person' and size(options) > 1")
    hits = unsure.select("author", F.explode("options").alias("g"), F.col("last").alias("s")).join(first_cores.where("kind = 'person'").select("g", "s"), ["g", "s"]).groupBy("author").agg(F.count("*").alias("c"), F.min("g").alias("g"))
    settled = unsure.join(hits, "author", "left").select("author", "n", "kind", F.when(F.col("c") == 1, F.col("g")).otherwise(F.col("first")).alias("g"), F.col("last").alias("s"))
    full = cut(sure.unionByName(settled))
    cores = full.groupBy("kind", "g", "s").agg(F.sum("n").alias("n"), F.count("*").alias("support"))
    # What initials or a login say for a core.
    own = cores.select("kind", "g", "s", F.explode(_spoken(F.col("kind"), F.col("g"), F.col("s"))).alias("fused"))
    said = parsed.where("kind = 'login'").select("fused").unionByName(parsed.where("kind = 'short'").select(F.concat("first", F.lit("."), "last").alias("fused"))).distinct()
    backed = own.join(said, "fused", "left_semi").select("kind", "g", "s").distinct().withColumn("backed", F.lit(1))
    cores = cores.join(backed, ["kind", "g", "s"], "left").withColumn("backed", F.coalesce("backed", F.lit(0)))
    fixed = cut(_misspelt(cores))
    # A target may itself be a variant: pointers double until none moves.
    while True:
        onward = fixed.select("kind", F.col("g").alias("g2"), F.col("s").alias("s2"), F.col("g2").alias("g3"), F.col("s2").alias("s3"))
        joined = cut(fixed.join(onward, ["kind", "g2", "s2"], "left").select("kind", "g", "s", F.coalesce("g3", "g2").alias("g2"), F.coalesce("s3", "s2").alias("s2"), F.col("g3").isNotNull().alias("moved")))
        fixed = joined.drop("moved")
        if not joined.where("moved").limit(1).count():
            break
    linked = full.join(fixed, ["kind", "g", "s"], "left").select("author", "kind", F.coalesce("g2", "g").alias("g"), F.coalesce("s2", "s").alias("s"))
    linked = cut(linked)
    heads = linked.select("kind", "g", "s").distinct()
    # Initials: the only given name with that initial and surname, else an entity of their own.
    people = heads.where("kind = 'person'").select(F.substring("g", 1, 1).alias("first"), F.col("s").alias("last"), "g")
    one = people.groupBy("first", "last").agg(F.count("*").alias("c"), F.min("g").alias("g"))
    short = parsed.where("kind = 'short'").join(one, ["first", "last"], "left").select("author", F.when(F.col("c") == 1, F.concat(F.lit("person:"), "g", F.lit(":"), "last")).otherwise(F.concat(F.lit("short:"), "first", F.lit(":"), "last")).alias("entity"))
    # Logins: the only core with that form, full forms first.
    forms = heads.select(F.concat_ws(":", "kind", "g", "s").alias("entity"), F.explode(F.when(F.col("kind") == "org", F.array(F.struct(F.concat(F.regexp_replace("s", "[^a-z0-9]", ""), "g").alias("fused"), F.lit(2).alias("strength")))).otherwise(_forms(F.col("g"), F.col("s")))).alias("x")).select("entity", "x.fused", "x.strength").distinct()
    alone = parsed.where("kind = 'short'").select(F.concat(F.lit("short:"), "first", F.lit(":"), "last").alias("entity"), F.explode(F.array(F.concat("first", F.regexp_replace("last", "[^a-z0-9]", "")), F.concat(F.regexp_replace("last", "[^a-z0-9]", ""), "first"))).alias("fused"), F.lit(0).alias("strength")).distinct()
    options = forms.unionByName(alone).groupBy("fused", "strength").agg(F.count("*").alias("c"), F.min("entity").alias("entity"))
    options = options.groupBy("fused").agg(F.max_by(F.struct("c", "entity"), "strength").alias("x")).select("fused", "x.*")
    login = parsed.where("kind = 'login'").join(options, "fused", "left").select("author", F.when(F.col("c") == 1, F.col("entity")).otherwise(F.concat(F.lit("login:"), "fused")).alias("entity"))
    return linked.select("author", F.concat_ws(":", "kind", "g", "s").alias("entity")).unionByName(short).unionByName(login)


def variant_pairs(links: DataFrame) -> DataFrame:
    """(author_a, author_b): pairs of spellings of one entity, a < b by UTF-8 bytes."""
    a, b = (links.select(F.col("author").alias(f"author_{x}"), "entity") for x in "ab")
    return a.join(b, "entity").where("author_a < author_b").select("author_a", "author_b")
