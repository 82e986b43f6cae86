"""Text functions as Column expressions; only canonical composition needs Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that part words, and those that part morphemes within a word.
SEPARATORS = r"""(?U)[（）［］「」『』“”«»\s|/\\{}\[\]()。！？；：，、"!?:;.,]+"""
#: The same characters one by one, with every blank that (?U)\s has.
SEPARATOR_CHARS = "（）［］「」『』“”«»|/\\{}[]()。！？；：，、\"!?:;.," + "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
MORPHEMES = "[-=~<>]+"
NOTATION = "-=<>…~*"
STOPWORDS = ("a", "an", "and", "at", "be", "for", "in", "is", "of", "on", "or", "the", "to", "with")
#: Variant apostrophes, schwa and spaces, folded one to one.
FOLD_FROM, FOLD_TO = "`´‘’ʼǝ\u3000\u00a0", "'''''ə  "


def composed(c: Column) -> Column:
    """Canonical composition; the one step that no built-in function has, so it is left out for text known to be composed."""
    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return nfc(c)


def without_marks(c: Column, preserve: str = "") -> Column:
    """Drops combining marks, but for the characters in preserve."""
    @F.pandas_udf("string")
    def bare(s: pd.Series) -> pd.Series:
        class Bare(dict):
            """What stays of each character, worked out once."""

            def __missing__(self, k: int) -> str:
                ch = chr(k)
                self[k] = ch if ch in preserve else "".join(y for y in unicodedata.normalize("NFD", ch) if not unicodedata.combining(y))
                return self[k]

        table = Bare()
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).translate(table)))

    return bare(c)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def base_key(c: Column) -> Column:
    """Lower case, folded characters, single spaces."""
    return collapse(F.translate(F.lower(c), FOLD_FROM, FOLD_TO))


def search_key(c: Column) -> Column:
    """base_key without notation characters."""
    return collapse(F.translate(base_key(c), NOTATION, ""))


def parted(c: Column, drop: str = "") -> Column:
    """Pieces of the folded text between separators, empty ones too, without the characters in drop. Every separator
    becomes a blank in the pass that folds, and a split at one plain character needs no regular expression."""
    blanks = "".join(x for x in SEPARATOR_CHARS if x not in FOLD_FROM)
    return F.split(F.translate(F.lower(F.coalesce(c, F.lit(""))), FOLD_FROM + blanks + drop, FOLD_TO + " " * len(blanks)), " ")


def split_words(c: Column) -> Column:
    """Whole words, in order, with repeats. Notation goes before the text is split, in one pass over it."""
    return F.array_remove(parted(c, NOTATION), "")


def tokenize(c: Column) -> Column:
    """Distinct words, each followed by its morphemes of at least two characters where it is marked for any. Texts without
    such marks aren't looked through word by word; of others each piece is looked at once."""
    bare = lambda w: F.translate(w, NOTATION, "")  # noqa: E731  (the rest of the key is there already)
    parts = lambda w: F.filter(F.transform(F.split(w, MORPHEMES), bare), lambda p: F.length(p) >= 2)
    both = F.flatten(F.transform(F.array_distinct(parted(c)), lambda w: F.when(w.rlike(MORPHEMES), F.concat(F.array(bare(w)), parts(w))).otherwise(F.array(bare(w)))))
    marked = F.array_distinct(F.array_remove(both, ""))
    return F.when(c.rlike(MORPHEMES), marked).otherwise(F.array_distinct(split_words(c)))


def gloss_tokens(c: Column) -> Column:
    """Distinct runs of letters, digits and inner apostrophes, in lower case. Marks are left to without_marks."""
    words = F.transform(F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}']+")), lambda w: F.btrim(w, F.lit("'")))
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def zh_key(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")


def has_han(c: Column) -> Column:
    return c.rlike(r"\p{IsHan}")


def query_mode(c: Column) -> Column:
    return F.when(has_han(c), "zh").otherwise("latin")


def derivation_candidates(c: Column) -> Column:
    """Readings of a free-form derivation note: the note itself, then the single words that = ~ , and ; part, without quoted
    glosses, bracketed remarks and question marks."""
    note = F.coalesce(c, F.lit(""))
    bare = F.regexp_replace(note, r"'[^']*'|\([^)]*\)|[?？]", " ")
    parts = F.transform(F.split(bare, "[;；，,~=]"), lambda p: F.trim(p))
    return F.array_distinct(F.concat(F.array(F.trim(note)), F.filter(parts, lambda p: (p != "") & ~p.rlike(r"(?U)\s"))))


def unit_class(text: Column, role: Column, form_type: Column | None = None) -> Column:
    """affix, sentence, phrase or word."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    words = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
    form = F.lit(None).cast("string") if form_type is None else form_type
    shape = t.rlike("^-|-$") | t.rlike("^<[^>]+>$")
    running = role.isin("example", "segment")
    return (
        F.when(form.isNotNull() & (form != "") & (form != "free"), "affix")
        .when((form.isNull() | (form == "")) & shape, "affix")
        .when(running & (t.rlike("[.!?。！？][”\"’')）]*$") | (words >= 3)), "sentence")
        .when(words >= 2, "phrase")
        .otherwise("word")
    )


def parse_timecode(c: Column) -> Column:
    """H:MM:SS.cc in seconds; null where the text is none."""
    part = lambda k: F.regexp_extract(c, r"^(\d+):(\d{1,2}):(\d{1,2})(?:[.,](\d{1,3}))?$", k)
    fraction = F.when(part(4) == "", 0.0).otherwise(F.concat(F.lit("0."), part(4)).cast("double"))
    return F.when(part(1) != "", F.round(part(1).cast("double") * 3600 + part(2).cast("double") * 60 + part(3).cast("double") + fraction, 3))


def format_timecode(seconds: Column) -> Column:
    """MM:SS.cc, with hours in front where there are any."""
    cs = F.round(seconds * 100).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    tail = F.concat(two(F.floor(cs % 360000 / 6000)), F.lit(":"), two(F.floor(cs % 6000 / 100)), F.lit("."), two(cs % 100))
    return F.when(cs >= 360000, F.concat(F.floor(cs / 360000).cast("string"), F.lit(":"), tail)).otherwise(tail)


def root_cost(c: Column, vowels: str, table: list[float]) -> Column:
    """Cost of a root by its number of vowels; the table's last entry holds for all longer ones."""
    n = F.length(c) - F.length(F.translate(c, vowels, ""))
    return F.element_at(F.lit(table), F.least(n, F.lit(len(table) - 1)) + 1)


def encode_mask(codes: Column, inventory: list[str]) -> Column:
    """A bit for each code of the inventory, at most 31."""
    if len(inventory) > 31:
        raise ValueError("a mask has room for 31 codes")
    return sum((F.when(F.array_contains(codes, c), 1 << i).otherwise(0) for i, c in enumerate(inventory)), F.lit(0)).cast("int")


def decode_mask(mask: Column, inventory: list[str]) -> Column:
    every = F.array(*(F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(c)) for i, c in enumerate(inventory)))
    return F.filter(every, lambda x: x.isNotNull())
