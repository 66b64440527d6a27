"""Folder and title names: skeletons, volume numbers, scores, tags."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Keywords of volumes that are kept rather, and of those that are still incomplete.
UNCENSORED = ("無修正", "decensored", "uncensored", "步兵", "流出")
ONGOING = ("進行中", "ongoing")
#: Bracketed tags that name neither artist nor group.
IGNORED_TAGS = ("chinese", "dl", "dl版", "中国翻訳", "翻訳", "uncensored", "eng", "english")
#: Words that announce a volume number, and those of them that a number is read after.
VOLUME_WORDS = ("vol", "ch", "chapter", "ep", "page", "book", "v", "第", "卷", "巻", "話", "话", "集", "冊", "册", "号", "號")
NUMBERED_WORDS = ("vol", "v", "第", "ch", "集", "冊", "卷")
#: Patterns of bracketed remarks, of a last number, of separators, and of a title's tags.
BRACKETED = r"\[.*?\]|\(.*?\)|【.*?】|（.*?）"
LAST_NUMBER = r"\s+#?\d+\s*$"
SEPARATORS = r"[-_\s.]+"
TAG = r"\[([^\]]+)\]"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, for which Spark has no function."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def composed(name: Column) -> Column:
    """NFKC. Names in plain ASCII equal theirs."""
    return nfkc(name)


def volume_number(name: Column) -> Column:
    words = "|".join(NUMBERED_WORDS)
    return F.nullif(F.regexp_extract(name, rf"(?i)(?:{words})\.?\s*(\d+)", 1), F.lit("")).cast("int")


def skeleton(name: Column) -> Column:
    """A series' name: without brackets, volume labels and a last number, single spaces, lower case.

    A name of which less than two letters are left is kept whole, in lower case.
    """
    words = "|".join(VOLUME_WORDS)
    bare = F.regexp_replace(name, BRACKETED, " ")
    bare = F.regexp_replace(bare, rf"(?i)({words})\.?\s*\d+", " ")
    bare = F.regexp_replace(bare, LAST_NUMBER, " ")
    bare = F.lower(F.trim(F.regexp_replace(bare, SEPARATORS, " ")))
    return F.when(F.length(bare) >= 2, bare).otherwise(F.lower(F.trim(name)))


def _has(name: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(name, F.lit(w))
    return out


def is_uncensored(name: Column) -> Column:
    return _has(F.lower(name), UNCENSORED)


def volume_score(name: Column) -> Column:
    """Incomplete volumes lose 500, uncensored ones win 100."""
    low = F.lower(name)
    return F.when(_has(low, ONGOING), -500).otherwise(0) + F.when(_has(low, UNCENSORED), 100).otherwise(0)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def title_tags(title: Column) -> Column:
    """The bracketed tags of a title that may name an artist or a group, in order."""
    found = F.transform(F.regexp_extract_all(title, F.lit(TAG), 1), lambda x: F.trim(x))
    return F.filter(found, lambda x: ~F.lower(x).isin(*IGNORED_TAGS))


def tag_artist(tag: Column) -> Column:
    """``group (artist)``: the artist; a tag without brackets is one itself."""
    inner = F.trim(F.regexp_extract(tag, r"[(（]([^)）]+)[)）]", 1))
    return F.when(inner != "", inner).otherwise(tag)


def tag_group(tag: Column) -> Column:
    """``group (artist)``: the group, null without brackets or where nothing precedes them."""
    return F.when(tag.rlike(r"[(（][^)）]+[)）]"), F.nullif(F.trim(F.regexp_extract(tag, r"^([^(（]*)", 1)), F.lit("")))


def close_match(keys: list[str], cutoff: float = 0.8):
    """A function that finds the closest of ``keys`` (a bounded dictionary) to a text over two letters."""

    @F.pandas_udf(StringType())
    def closest(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = set(keys)

        def one(x: str | None) -> str | None:
            if not x:
                return None
            x = unicodedata.normalize("NFKC", x).lower().strip()
            if x in known:
                return x
            near = difflib.get_close_matches(x, keys, n=1, cutoff=cutoff) if len(x) > 2 else []
            return near[0] if near else None

        for part in text:
            cache = {x: one(x) for x in part.dropna().unique()}
            yield part.map(lambda x, c=cache: c.get(x))

    return closest


def _capitals(text: str) -> str:
    """Capitals at the start of every run of letters, after digits and apostrophes too."""
    return re.sub(r"[^\W\d_]+", lambda m: m.group().capitalize(), text)


def known_name(text: str, names: dict[str, str], keys: list[str], cutoff: float = 0.8) -> str:
    """A dictionary's name of a text: by its composed lower-case form, or from three letters on by the nearest key."""
    key = unicodedata.normalize("NFKC", text).lower().strip()
    if key in names:
        return names[key]
    near = difflib.get_close_matches(key, keys, n=1, cutoff=cutoff) if len(key) > 2 else []
    return names[near[0]] if near else ""


def artist_and_group(title: str | None, artists: dict[str, str], groups: dict[str, str]) -> tuple[str, str]:
    """Who a title names in its bracketed tags, in order: ``[group (artist)]``, or a tag that is one of both.

    Known names are spelled as the dictionaries have them, others in plain letters with capitals. A tag alone is
    an artist or a group by the dictionaries; else it fills what is still open, the artist first, and one that
    isn't in plain letters only the artist.
    """
    found, keys = {"artist": "", "group": ""}, {"artist": list(artists), "group": list(groups)}
    names = {"artist": artists, "group": groups}

    def spelled(kind: str, text: str) -> str:
        return known_name(text, names[kind], keys[kind]) or (_capitals(text) if text.isascii() else text)

    for tag in re.findall(TAG, title or ""):
        tag = tag.strip()
        if tag.lower() in IGNORED_TAGS:
            continue
        if inner := re.search(r"[(（]([^)）]+)[)）]", tag):
            parts = {"artist": inner.group(1).strip(), "group": re.split(r"[(（]", tag)[0].strip()}
            for kind, text in parts.items():
                if text and not found[kind]:
                    found[kind] = spelled(kind, text)
            continue
        mapped = {kind: known_name(tag, names[kind], keys[kind]) for kind in found}
        by_map = next((kind for kind in found if mapped[kind] and not found[kind]), None)
        if by_map:
            found[by_map] = mapped[by_map]
        elif not tag.isascii():
            found["artist"] = found["artist"] or tag
        elif open_ := next((kind for kind in found if not found[kind]), None):
            found[open_] = _capitals(tag)
    return found["artist"], found["group"]


def named_in(artists: dict[str, str], groups: dict[str, str]):
    """A function of titles to struct(artist, group), by dictionaries of a bounded size."""

    @F.pandas_udf("artist string, group string")
    def named(titles: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in titles:
            known = {x: artist_and_group(x, artists, groups) for x in part.dropna().unique()}
            rows = [known.get(x, ("", "")) for x in part]
            yield pd.DataFrame(rows, columns=["artist", "group"])

    return named
