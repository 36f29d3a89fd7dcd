"""Text expressions: every function takes and returns Columns and stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Python's str.isspace accepts, and the same without the line feed.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
SPACE_IN_LINE = r"[\x09\x0B-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
NUL = "\x00"


def strip(c: Column) -> Column:
    """Without white space at either end, as Python's strip."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is read: a lambda's argument is a value, a column's name stands for its expression."""
    return F.transform(F.array(value), use)[0]


def newlines(c: Column) -> Column:
    """CR LF and CR become LF."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def clean(c: Column) -> Column:
    """Scan text to paragraphs: rejoin hyphenated line ends, unwrap lines, keep paragraph breaks, collapse blanks."""
    # fixed values: the patterns and their order, which the result depends on
    c = F.regexp_replace(c, rf"-{SPACE}*\n{SPACE}*", "")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, rf"{SPACE_IN_LINE}*\n{SPACE_IN_LINE}*", "\n")
    c = F.regexp_replace(c, rf"\A{SPACE_IN_LINE}+|{SPACE_IN_LINE}+\z", "")
    c = F.regexp_replace(c, r"\n{2,}", NUL)
    c = F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit(NUL), F.lit("\n\n"))
    c = F.regexp_replace(c, r" {2,}", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def collapse(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"{SPACE}+", " "))


def words(c: Column) -> Column:
    """Lower-cased runs of a-z and apostrophe."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z']+"), F.lit(0))


def words_cased(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[A-Za-z']+"), F.lit(0))


def grams(ws: Column, n: int) -> Column:
    """The bag of n-grams of a column of words, each joined by blanks; ``ws`` must be a stored column, as it is read for every n-gram."""
    return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(ws, i, n), " "))).otherwise(F.array().cast("array<string>"))


def paragraphs(c: Column) -> Column:
    return F.filter(F.split(c, rf"\n{SPACE}*\n"), lambda p: F.length(strip(p)) > 0)


def eol_hyphens(c: Column) -> Column:
    return F.regexp_count(c, F.lit(rf"[A-Za-z]-{SPACE}*\n{SPACE}*[A-Za-z]"))


def strip_boilerplate(c: Column, marker: str) -> Column:
    """The body of an e-book: between its START and END banners, from ``marker`` on, without plates, headings and italics marks; NULL where a banner or the marker is missing."""
    # the banners, headings and folds below are fixed values; a heading's word ends before anything but a letter, digit or low line, as Python's \b has it
    start, end = rf"\*\*\*{SPACE}*START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*?\*\*\*", rf"\*\*\*{SPACE}*END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK"
    whole = F.regexp_extract(c, rf"(?sd)\A.*?(?-s:{start})(.*?){end}", 1)
    has = c.rlike(rf"(?sd)(?-s:{start}).*?{end}")
    at = F.locate(marker, whole)
    body = F.when(has & (at > 0), F.substring(whole, at, F.length(whole)))
    body = F.replace(F.regexp_replace(body, r"(?s)\[Illustration:.*?\]", ""), F.lit("[Illustration]"), F.lit(""))
    body = F.regexp_replace(body, rf"(?md)^{SPACE}*(?:CHAPTER|Chapter|BOOK|Book the|VOLUME|PART|PRELUDE|FINALE)(?:[^\p{{L}}\p{{N}}_\n].*)?$", "")
    body = F.regexp_replace(body, rf"(?md)^{SPACE}*[IVXLC]+\.?{SPACE}*$", "")
    return F.translate(F.replace(body, F.lit("_"), F.lit("")), "\u201c\u201d\u2018\u2019\u2013\u00a0\ufeff", "\"\"''- ")


#: Fixed value: what counts as an identifier.
IDENTIFIER = r"(?U)(?:[a-z][a-z0-9]*(?:-[a-z0-9]+){1,}|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b[0-9a-f]{7,40}\b|\b[A-Z]{3,}\b|\b\d+(?:\.\d+)?(?:ms|MB|GB|s|%|h)\b|\b\w+\.(?:py|sh|md|json|log|csv|state)\b)"


def identifiers(c: Column, budget: Column | int) -> Column:
    """Distinct identifiers in order of appearance, joined and cut to ``budget`` characters."""
    b = F.lit(budget) if isinstance(budget, int) else budget
    return F.substring(F.array_join(F.array_distinct(F.regexp_extract_all(c, F.lit(IDENTIFIER), F.lit(0))), " "), F.lit(1), b)


def extractive(c: Column, budget: Column | int) -> Column:
    """A summary made of a text's own words.

    The distinct lines are cut into runs of equal length; of each run the longest line gives its first two sentences.
    """
    b = F.lit(budget) if isinstance(budget, int) else budget
    lines = F.array_distinct(F.filter(F.split(c, "\n"), lambda x: x.rlike(SPACE.replace("[", "[^", 1))))

    def opening(block: Column, most: Column) -> Column:
        longest = F.reduce(block, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
        return bound(F.split(F.element_at(F.split(longest, ": ", 2), -1), r"(?<=[.!?]) ", 3), lambda s: F.substring(F.array_join(F.slice(s, 1, 2), " "), F.lit(1), most))

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(v["n"], F.lit(1)), v["seg"]), lambda i: F.slice(v["lines"], i, v["seg"]))
        said = F.transform(F.filter(blocks, lambda x: F.size(x) > 0), lambda x: opening(x, F.floor(b / v["k"]).cast("int")))
        return F.substring(collapse(F.array_join(said, " ")), F.lit(1), b)

    k = lambda n: F.greatest(F.lit(1), F.least(n, F.lit(6)))
    seg = lambda n: F.greatest(F.lit(1), F.floor(n / k(n)).cast("int"))
    return bound(lines, lambda x: bound(F.when(x.isNotNull(), F.struct(x.alias("lines"), F.size(x).alias("n"), k(F.size(x)).alias("k"), seg(F.size(x)).alias("seg"))), whole))


def strip_tag_prefix(body: Column, window: Column) -> Column:
    """``[tag] window: text`` to ``text``; the window in any case."""
    b = F.regexp_replace(body, r"\A\[([a-z0-9-]+)\]\s*", "")
    cut = F.startswith(F.lower(b), F.concat(F.lower(window), F.lit(":")))
    return strip(F.when(cut, F.substring(b, F.length(window) + 2, F.length(b))).otherwise(b))


def even_chunks(ids: Column, size: int, most: int) -> Column:
    """Arrays of ``size`` items spread evenly over ``ids``; starts are rounded half to even."""
    n_ids = F.size(ids)
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(n_ids / size).cast("int")))
    span = n_ids - size
    spread = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(ids, F.bround(i * span / F.greatest(n - 1, F.lit(1))).cast("int") + 1, size))
    return F.when(n_ids <= size, F.array(ids)).when(n == 1, F.array(F.slice(ids, 1, size))).otherwise(spread)


def byte_id(b: Column) -> Column:
    """The id of a byte in a byte-level vocabulary whose id 0 is the special token.

    The printable bytes of Latin-1 come first, in order; those that have no printable sign of their own (blanks,
    controls, 127 to 160 and 173) follow, in order.
    """
    return (
        F.when(b.between(33, 126), b - 32).when(b.between(161, 172), b - 66).when(b.between(174, 255), b - 67)
        .when(b <= 32, b + 189).when(b <= 160, b + 95).otherwise(256))


def byte_tokens(c: Column, prefix_blank: bool = True) -> Column:
    """Ids of the UTF-8 bytes in the byte vocabulary, with a blank in front; each byte is read as a character of Latin-1."""
    text = F.concat(F.lit(" "), c) if prefix_blank else c
    ids = F.array(*[byte_id(F.lit(b)) for b in range(256)])
    return F.transform(F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")), lambda x: F.get(ids, F.ascii(x)))


def chat_prompt(user: Column, system: str | None = None) -> Column:
    parts = [F.lit(f"System: {system}\n\n")] if system else []
    return F.concat(*parts, F.lit("User: "), user, F.lit("\n\nAssistant:"))
