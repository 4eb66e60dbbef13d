"""Column functions over text. All of them are built-in Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spanish letters, written out: \\w is ASCII in Java's patterns.
LETTERS = "a-záéíóúüñA-ZÁÉÍÓÚÜÑ"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyzáéíóúüñ", "ABCDEFGHIJKLMNOPQRSTUVWXYZÁÉÍÓÚÜÑ"
ACCENTED = "áàâäãéèêëíìîïóòôöõúùûüçÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇ"
PLAIN = "aaaaaeeeeiiiiooooouuuucAAAAAEEEEIIIIOOOOOUUUUC"
#: Speech between dashes, guillemets or quotes, as one alternation: the earliest mark wins.
DIALOGUE = "—[^—\n]+|«[^»\n]+»|“[^”\n]+”|\"[^\"\n]+\""


def empty_as(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row: where a lambda refers to a column, Spark computes that column again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_accents(text: Column, keep_enye: bool = True) -> Column:
    return F.translate(text, ACCENTED + ("" if keep_enye else "ñÑ"), PLAIN + ("" if keep_enye else "nN"))


#: What plain() maps: capitals and accented letters, each to one letter, so that offsets stay.
_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PLAIN_FROM, PLAIN_TO = _ASCII_UPPER + ACCENTED + "ñÑ", _ASCII_UPPER.lower() + PLAIN.lower() + "nn"
WORD_CHARS = "0-9A-Za-z_"


def plain(text: Column) -> Column:
    """Lower case without accents, character by character: for patterns written in plain ASCII, with the text's own offsets."""
    return F.translate(empty_as(text), PLAIN_FROM, PLAIN_TO)


def whole_words(pattern: str) -> str:
    """The pattern where no ASCII word character adjoins; the same as \\b on both sides in engines without look-around."""
    return f"(?<![{WORD_CHARS}])(?:{pattern})(?![{WORD_CHARS}])"


def normalize_name(name: Column) -> Column:
    """Without accents, lower case, single spaces; ñ becomes n."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(name), keep_enye=False), r"\s+", " "))


def word_list(text: Column) -> Column:
    """The runs of Spanish letters of a text. Splitting at all else takes a third of the time of matching each word."""
    return F.array_remove(F.split(empty_as(text), f"[^{LETTERS}]+"), "")


#: White space that is trimmed from sentences, and a mark that stands at their ends while a text is split.
SPACE, END = " \t\n\x0b\f\r", "\x01"


def sentences(text: Column, least_tail: int = 10) -> Column:
    """The sentences of a text: each ends with marks before white space, a closing quote or bracket, or the end; a tail without a mark counts from least_tail characters on.

    Ends are marked in one pass and the text is split there, so that a long run without marks is read once."""
    plain = F.translate(empty_as(text), END, " ")
    parts = F.split(F.regexp_replace(plain, r"((?<![.!?])[.!?]++(?:\s|\z|[\"')»]))", "$1" + END), END)
    whole = lambda trimmed: F.filter(trimmed, lambda s, i: (s != "") & ((F.length(s) >= least_tail) | (i < F.size(trimmed) - 1)))
    return let(F.transform(parts, lambda s: F.btrim(s, F.lit(SPACE))), whole)


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def char_ngrams(text: Column, n: int) -> Column:
    """The distinct runs of n characters, in order. The text is split into characters once, as reaching into a string costs its length."""
    chars = F.split(text, "")
    out = F.slice(chars, F.lit(1), F.length(text) - n + 1)
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(chars, F.lit(k), F.length(text) - n + 1), lambda a, b: F.concat(a, b))
    return F.when(F.length(text) >= n, F.array_distinct(out)).otherwise(F.array().cast("array<string>"))


def syllables(word: Column) -> Column:
    """Vowel groups, one more for each strong vowel after a strong one; at least 1 for any lettered word."""
    w = F.regexp_replace(F.lower(word), "[^a-záéíóúüñ]", "")
    groups = F.regexp_count(w, F.lit("[aeiouáéíóúü]+"))
    hiatus = F.regexp_count(w, F.lit("[aeoáéó](?=[aeoáéó])"))
    return F.when(F.length(w) == 0, 0).otherwise(F.greatest(F.lit(1), groups + hiatus)).cast("long")


def text_syllables(text: Column) -> Column:
    """The syllables of all words of a text, counted as by `syllables` but in three passes over the text: vowels outside words there are none."""
    low = F.translate(empty_as(text), UPPER, LOWER)
    count = lambda p: F.regexp_count(low, F.lit(p))
    without = count(f"(?<![{LOWER}])[bcdfghjklmnpqrstvwxyzñ]++(?![{LOWER}])")  # words without a vowel have one
    return (count("[aeiouáéíóúü]++") + count("[aeoáéó](?=[aeoáéó])") + without).cast("long")


def without_dialogue(text: Column) -> Column:
    return F.regexp_replace(empty_as(text), DIALOGUE, " ")


def dialogue_chars(text: Column) -> Column:
    return (F.length(empty_as(text)) - F.length(F.regexp_replace(empty_as(text), DIALOGUE, ""))).cast("long")


def occurrences(text: Column, part: str) -> Column:
    """How often part occurs as a substring, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def roman_to_int(numeral: Column) -> Column:
    """A Roman numeral's value: a letter before a larger one counts against it."""
    values = F.create_map(*[F.lit(x) for pair in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000)) for x in pair])
    step = lambda acc, c: F.struct(
        (acc["total"] + F.when(values[c] > acc["last"], values[c] - 2 * acc["last"]).otherwise(values[c])).cast("int").alias("total"), values[c].alias("last"))
    start = F.struct(F.lit(0).alias("total"), F.lit(10_000).alias("last"))
    return F.aggregate(F.regexp_extract_all(F.upper(numeral), F.lit("[IVXLCDM]"), F.lit(0)), start, step, lambda acc: acc["total"])


def sanitize(text: Column, limit: int = 10_000_000) -> Column:
    """Without NUL, line ends unified, cut at a limit."""
    return F.substring(F.regexp_replace(F.translate(text, "\0", ""), "\r\n?", "\n"), 1, limit)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equally long vectors in double precision; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)
