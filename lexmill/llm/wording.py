"""The wording of a text: its words without anything that leaves the wording alone.

Set aside are the form of letters (width, presentation forms, look-alikes, alef / yeh / kaf / heh variants), combining marks,
stretching, punctuation, hash signs, emoji, handles, links and forward marks. Scripts without spaces give one word per letter.

Texts of characters whose wording doesn't depend on their neighbours go through one table from a character to what stands for it,
which fills itself; other texts take the general way. Both give the same words.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of one form, and look-alikes of Latin letters.
VARIANTS = {
    "إ": "ا", "أ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ی": "ي", "ې": "ي", "ئ": "ي", "ؤ": "و", "ک": "ك", "ڪ": "ك", "ة": "ه", "ۃ": "ه", "ھ": "ه", "ہ": "ه", "ە": "ه", "ı": "i",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "т": "t", "в": "b", "к": "k", "м": "m", "н": "h", "ο": "o", "α": "a", "ν": "v", "ι": "i",
}
DIGITS = {z + k: ord("0") + k for z in (0x660, 0x6F0, 0x966) for k in range(10)}
_TABLE = {ord(k): v for k, v in VARIANTS.items()} | DIGITS

_GONE = regex.compile(r"[\p{Cf}͏︀-️ـ]")
_MARKS = regex.compile(r"[̀-ͯؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۨ-ۭ]")
_LINK = regex.compile(r"(?:https?://|www\.|pic\.(?=\S+/))\S*", regex.I)
_HANDLE = regex.compile(r"(?<![\w.])@\w+:?")
_FORWARD = regex.compile(r"(?<!\w)rt(?=\s*@)")
_STRETCH = regex.compile(r"(\p{L})\1+")
_WORD = regex.compile(r"[฀-๿--\p{M}]\p{M}*|[぀-ヿ㐀-鿿豈-﫿]\p{M}*|[[\p{L}\p{M}\p{N}]--[฀-๿぀-ヿ㐀-鿿豈-﫿]]+", regex.V1)


def _general(text: str) -> list[str]:
    t = _GONE.sub("", unicodedata.normalize("NFKC", text)).lower()
    t = _HANDLE.sub(" ", _FORWARD.sub(" ", _LINK.sub(" ", t)))
    t = _MARKS.sub("", unicodedata.normalize("NFKD", t)).translate(_TABLE)
    return _WORD.findall(_STRETCH.sub(r"\1", unicodedata.normalize("NFC", t)))


class _Characters(dict):
    """What stands for a character of a text that is composed and in lower case: its letters, a blank, or nothing."""

    def __missing__(self, cp: int) -> str:
        t = _MARKS.sub("", unicodedata.normalize("NFKD", _GONE.sub("", chr(cp)))).translate(_TABLE)
        out = "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in unicodedata.normalize("NFC", t))
        self[cp] = out
        return out


_OF = _Characters()
# Other characters than these may depend on their neighbours: marks that compose, letters of several forms, scripts without spaces.
_CONTEXT = re.compile("[^\x00-ʯ؀-ۿ‐-⁠™-⑟─-❵➔-➿　-。ﭐ-﷿︎️ﹰ-﻿！-～\U0001f000-\U0001faff]")
_LETTERS = re.compile(r"([^\W\d_])\1+")


def words_of(text: str | None) -> list[str]:
    """The words that make up the wording of ``text``; none for a null or empty text."""
    if not text:
        return []
    if _CONTEXT.search(text):
        return _general(text)
    t = unicodedata.normalize("NFKC", text).lower()
    if "@" in t or "/" in t or "." in t:
        t = _GONE.sub("", t)
        if "://" in t or "www." in t or "pic." in t:
            t = _LINK.sub(" ", t)
        if "@" in t:
            t = _HANDLE.sub(" ", _FORWARD.sub(" ", t))
    return _LETTERS.sub(r"\1", t.translate(_OF)).split()


@F.pandas_udf(T.StringType())
def _joined(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: " ".join(words_of(t)))


def joined(text: Column | str) -> Column:
    """The wording of a text column as words with blanks between them; empty for null and wordless texts."""
    return _joined(F.col(text) if isinstance(text, str) else text)


def words(text: Column | str) -> Column:
    """The wording of a text column, as an array of words (empty for null)."""
    return F.filter(F.split(joined(text), " "), lambda w: w != "")
