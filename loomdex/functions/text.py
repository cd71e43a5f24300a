"""Text as Column expressions: tokens, accents, HTML, titles, cursors, dates of archives and forums."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Letters with accents and their base letters, by canonical decomposition."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]):
            pairs[chr(code)] = base[0]
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _accents()
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.regexp_replace(F.translate(F.lower(c), _FROM, _TO), r"[̀-ͯ]", "")


def tokens(c: Column) -> Column:
    """Array of folded runs of letters and digits; empty for null."""
    return F.coalesce(F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def fold_text(s: str) -> str:
    """``fold`` for query text on the driver."""
    return "".join(c for c in s.lower().translate(str.maketrans(_FROM, _TO)) if not "̀" <= c <= "ͯ")


def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def unescape_html(c: Column) -> Column:
    """Six entities in a fixed order, ``&amp;`` first, so that doubly escaped text is undone once more."""
    for entity, text in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        c = F.replace(c, F.lit(entity), F.lit(text))
    return c


# The markers of pages, mails, feeds and specifications in the patterns below.
def page_title(html: Column) -> Column:
    """Trimmed, unescaped text of ``<title>``; null if there is none."""
    return F.nullif(F.trim(unescape_html(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1))), F.lit(""))


def board_id(html: Column) -> Column:
    """Number in the last board link of a forum page."""
    return F.try_element_at(F.regexp_extract_all(html, F.lit(r'<a[^>]+href="[^"]*\bboard=(\d+)'), F.lit(1)), F.lit(-1)).try_cast("bigint")


def board_name(html: Column) -> Column:
    """Unescaped text of the last board link."""
    return unescape_html(F.trim(F.try_element_at(F.regexp_extract_all(html, F.lit(r'<a[^>]+href="[^"]*\bboard=\d+[^"]*"[^>]*>([^<]+)</a>'), F.lit(1)), F.lit(-1))))


def page_count(html: Column) -> Column:
    """Largest page number among the pager's links, 1 without a pager."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(html, F.lit(r'<a\s+class="navPages"[^>]*>(\d+)</a>'), F.lit(1)), lambda x: x.try_cast("bigint"))), F.lit(1))


def topic_ids(html: Column) -> Column:
    """Topic numbers linked from a page, in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(r"topic=(\d+)\.msg\d+#msg\d+"), F.lit(1)), lambda x: x.try_cast("bigint")))


def forum_posts(html: Column) -> Column:
    """Array of (msg, author, author_id, date, body) of a topic page, empty bodies dropped. A section starts at each message anchor."""
    sections = F.filter(F.split(html, r'(?=<a\s+[^>]*name="msg\d+")'), lambda s: s.rlike(r'^<a\s+[^>]*name="msg\d+"'))
    profile = r'action=profile;u=(\d+)"[^>]*>([^<]+)</a>'

    def post(s: Column) -> Column:
        author = F.nullif(unescape_html(F.trim(F.regexp_extract(s, profile, 2))), F.lit(""))
        body = F.trim(unescape_html(strip_html(F.regexp_extract(s, r'<div\s+class="post"[^>]*>([\s\S]*?)</div>', 1))))
        return F.struct(F.regexp_extract(s, r'name="msg(\d+)"', 1).try_cast("bigint").alias("msg"), F.coalesce(author, F.lit("Unknown")).alias("author"), F.nullif(F.regexp_extract(s, profile, 1), F.lit("")).alias("author_id"),
                        forum_date(F.regexp_extract(s, r"(\w+ \d{1,2}, \d{4}, \d{1,2}:\d{2}:\d{2} (?:AM|PM))", 1)).alias("date"), body.alias("body"))

    return F.filter(F.transform(sections, post), lambda p: p["body"] != "")


def forum_date(c: Column) -> Column:
    """``January 26, 2019, 06:03:38 AM`` as UTC."""
    return F.try_to_timestamp(c, F.lit("MMMM d, yyyy, hh:mm:ss a"))


def mail_date(c: Column) -> Column:
    """RFC 2822 first, with any white space between its parts, then RFC 3339, else null."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"^(?i)(mon|tue|wed|thu|fri|sat|sun),? +", ""), r" *\([^)]*\)$", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r" (GMT|UTC|UT|Z)$", " +0000"), " +", " ")
    seconds = F.when(plain.rlike(r" \d{2}:\d{2} "), F.regexp_replace(plain, r"( \d{2}:\d{2}) ", "$1:00 ")).otherwise(plain)
    mail = F.when(seconds.rlike(r"^\d{1,2} \p{L}{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), F.try_to_timestamp(F.initcap(seconds), F.lit("d MMM yyyy HH:mm:ss xx")))
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(F.upper(c)))
    return F.coalesce(mail, iso)


def mail_headers(raw: Column) -> Column:
    """(subject, sender, date, body): headers up to the first blank line, folded lines joined by a space, names in any case, the last one
    wins, empty values are none; the body is trimmed, null if empty."""
    text = F.replace(raw, F.lit("\r\n"), F.lit("\n"))
    head = F.when(F.instr(text, "\n\n") > 0, F.substring_index(text, "\n\n", 1)).otherwise(text)
    body = F.when(F.instr(text, "\n\n") > 0, F.nullif(F.regexp_replace(text.substr(F.length(head) + 3, F.length(text)), r"^\s+|\s+$", ""), F.lit("")))
    unfolded = F.regexp_replace(head, r"\n[ \t]+", " ")

    def last(name: str) -> Column:
        found = F.filter(F.transform(F.regexp_extract_all(unfolded, F.lit(rf"(?im)^{name}:(.*)$"), F.lit(1)), lambda v: F.trim(v)), lambda v: v != "")
        return F.try_element_at(found, F.lit(-1))

    return F.struct(last("subject").alias("subject"), last("from").alias("sender"), mail_date(last("date")).alias("date"), body.alias("body"))


def archive_page(html: Column) -> Column:
    """(subject, sender, date, body) of an archive page: subject and sender by their itemprop marks, the body behind its marker, up to its footer rule."""
    clean = lambda c: F.nullif(F.trim(unescape_html(c)), F.lit(""))
    sender = F.regexp_extract(html, r"""(?s)class="sender(.*?)</span></a></span>""", 1)
    body = unescape_html(strip_html(F.regexp_extract(html, r"(?s)<!--X-Body-of-Message-->(.*?)</div>", 1)))
    body = F.nullif(F.trim(F.substring_index(body, "_" * 47, 1)), F.lit(""))
    date = F.regexp_extract(html, r"""(?s)class="date"[^>]*>\s*<a[^>]*>([^<]*)<""", 1)
    return F.struct(clean(F.regexp_extract(html, r"""itemprop="name"[^>]*>([^<]*)<""", 1)).alias("subject"), clean(F.regexp_extract(F.concat(sender, F.lit("<")), r"""itemprop="name"[^>]*>([^<]*)<""", 1)).alias("sender"), mail_date(clean(date)).alias("date"), body.alias("body"))


def atom_entries(xml: Column) -> Column:
    """Array of (link, updated) of feed entries that have both."""
    entries = F.regexp_extract_all(xml, F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))
    both = F.transform(entries, lambda e: F.struct(F.regexp_extract(e, r'<link[^>]*href="([^"]*)"', 1).alias("link"), F.trim(F.regexp_extract(e, r"(?s)<updated>(.*?)</updated>", 1)).alias("updated")))
    return F.filter(both, lambda e: (e["link"] != "") & (e["updated"] != ""))


def message_id(link: Column, list_name: str) -> Column:
    """Text after ``/pi/{list}/`` without trailing slashes, else the last path segment."""
    bare = F.regexp_replace(link, "/+$", "")
    after = F.regexp_extract(bare, rf"/pi/{list_name}/(.+)$", 1)
    return F.coalesce(F.nullif(after, F.lit("")), F.element_at(F.split(bare, "/"), -1))


def _lines(body: Column, n: int) -> Column:
    return F.slice(F.split(body, "\n"), 1, n)


def _first(lines: Column, pattern: str, group: int = 1) -> Column:
    hit = F.try_element_at(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(1))
    return F.nullif(F.trim(F.regexp_extract(hit, pattern, group)), F.lit(""))


def spec_title(source_type: Column, body: Column, number: Column) -> Column:
    """Title of a specification by its kind, from the first lines of its text; falls back on its number."""
    n = number.cast("string")
    padded = F.lpad(n, 2, "0")
    titled = lambda p, k, t: F.coalesce(F.concat(F.lit(f"{p}-"), k, F.lit(": "), t), F.concat(F.lit(f"{p}-"), k))
    bip = _first(_lines(body, 30), r"^\s*(?:\|?\s*Title\s*[:=])\s*(.+)$")
    bolt = _first(_lines(body, 5), r"^#\s*(.+)$")
    heading = _first(_lines(body, 10), r"^#(?!#)\s*(.+)$")
    blip = _first(_lines(body, 30), r"^\s*(?:Title:|#+)\s*(.+)$")
    named = lambda p: F.when(heading.rlike(rf"^(?i){p}-"), heading).otherwise(titled(p, padded, heading))
    return (
        F.when(source_type == "bip", titled("BIP", n, bip))
        .when(source_type == "bolt", F.coalesce(bolt, F.concat(F.lit("BOLT-"), n)))
        .when(source_type == "blip", titled("bLIP", n, blip))
        .when(source_type == "lud", named("LUD"))
        .when(source_type == "nut", named("NUT"))
    )


def front_matter_title(body: Column) -> Column:
    """Unquoted ``title:`` between the first two ``---`` lines."""
    head = F.regexp_extract(body, r"(?s)^---\n(.*?)\n---", 1)
    return F.nullif(F.regexp_replace(F.regexp_extract(head, r"(?m)^title: *(.*)$", 1), "^['\"]|['\"]$", ""), F.lit(""))


def issue_number(title: Column) -> Column:
    """Digits after the first ``#``."""
    return F.nullif(F.regexp_extract(title, r"^[^#]*#(\d+)", 1), F.lit(""))


# Cursors of the paged sources.
def forum_cursor(c: Column) -> Column:
    """(mode, position, misses) of ``topic:N|misses:M`` or ``tail:N``."""
    number = lambda p: F.regexp_extract(c, p, 1).try_cast("bigint")
    return F.struct(F.when(c.startswith("tail:"), "tail").otherwise("topic").alias("mode"), F.coalesce(number(r"^(?:topic|tail):(\d+)"), F.lit(1)).alias("position"), F.coalesce(number(r"misses:(\d+)"), F.lit(0)).alias("misses"))


def month_cursor(c: Column, start: str = "2011-06") -> Column:
    """(month, offset) of ``YYYY-MM[:OFFSET]``, the first month without a cursor."""
    text = F.coalesce(c, F.lit(start))
    return F.struct(F.substring_index(text, ":", 1).alias("month"), F.coalesce(F.nullif(F.regexp_extract(text, r":(\d+)$", 1), F.lit("")).try_cast("int"), F.lit(0)).alias("offset"))


def next_month(month: Column) -> Column:
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), 1), "yyyy-MM")


# Forms of the addresses that the sources are read from.
def feed_url(base: str, month: Column, offset: Column) -> Column:
    """Feed of one month of a list archive, from an offset on."""
    url = F.concat(F.lit(f"{base}/?q=d:"), month, F.lit("-01.."), next_month(month), F.lit("-01&x=A"))
    return F.when(offset > 0, F.concat(url, F.lit("&o="), offset.cast("string"))).otherwise(url)


def raw_url(link: Column) -> Column:
    """Plain text of a message page."""
    return F.concat(F.regexp_replace(link, "/+$", ""), F.lit("/raw"))


def log_url(base: str, channel: Column, day: Column) -> Column:
    """Log of a channel on a day."""
    return F.concat(F.lit(f"{base}/"), channel, F.lit("/"), F.date_format(day, "yyyy-MM-dd"), F.lit(".log"))


def archive_url(address: Column, number: Column) -> Column:
    """Message page by number, padded to five digits."""
    return F.concat(F.lit("https://www.mail-archive.com/"), address, F.lit("/msg"), F.format_string("%05d", number), F.lit(".html"))
