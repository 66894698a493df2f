"""Keys that need Python: the scorable slug (Unicode NFKD) and NYSIIS. Both run on Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import Col, col

#: Letters that NFKD leaves alone, and look-alikes that scanning produces; upper and lower case fold the same way.
_FOLD = dict(zip("ðøßđħıĸłŋŧµƒαβικχυνγτο", "dosdhiklntufabikxuvyto", strict=True)) | {"æ": "ae", "þ": "th", "œ": "oe"}
_FOLD |= dict.fromkeys("∂ʖ∑∏ˆ☃ˇ", "")
_TABLE = str.maketrans(_FOLD)
_LEADS = ("title: ", "article: ", "original article: ", "original article ")
_DROP = regex.compile(r"[\p{P}\p{M}\s\u2E00-\u2E7F\u2000-\u206F" + "".join(f"\\u{ord(c):04X}" for c in "$+<=>^`|~¢£¤¥§©¬®°±´÷ʖ‘’“”€∆∞√∫≈≠≤≥◊«·»¿ƒ–_「」") + "]")


def scorable_text(raw: str, keep_lead: bool = False) -> str:
    """Folded, unspaced and unpunctuated lower-case text for comparing titles.

    A leading label such as ``title:`` is removed. With ``keep_lead`` the label alone is
    kept instead, which is what older keys of this kind hold.
    """
    s = raw.strip().lower()
    for lead in _LEADS:
        if s.startswith(lead):
            s = s[: len(lead)] if keep_lead else s[len(lead) :]
    s = s.replace("&apos;", "'").translate(_TABLE).lower()
    return _DROP.sub("", unicodedata.normalize("NFKD", s)).lower()


def _nysiis(word: str) -> str:
    """New York State Identification and Intelligence System code of one word."""
    w = "".join(c for c in word.upper() if "A" <= c <= "Z")
    if not w:
        return ""
    for old, new in (("MAC", "MCC"), ("KN", "NN"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS")):
        if w.startswith(old):
            w = new + w[len(old) :]
            break
    for ends, new in ((("EE", "IE"), "Y"), (("DT", "RT", "RD", "NT", "ND"), "D")):
        if w.endswith(ends):
            w = w[:-2] + new
            break
    out, i = w[0], 1
    w = list(w)
    while i < len(w):
        rest = "".join(w[i:])
        if rest.startswith("EV"):
            w[i : i + 2] = "AF"
        elif w[i] in "AEIOU":
            w[i] = "A"
        elif w[i] == "Q":
            w[i] = "G"
        elif w[i] == "Z":
            w[i] = "S"
        elif w[i] == "M":
            w[i] = "N"
        elif rest.startswith("KN"):
            w[i : i + 2] = "NN"
        elif w[i] == "K":
            w[i] = "C"
        elif rest.startswith("SCH"):
            w[i : i + 3] = "SSS"
        elif rest.startswith("PH"):
            w[i : i + 2] = "FF"
        elif w[i] == "H" and (w[i - 1] not in "AEIOU" or (i + 1 < len(w) and w[i + 1] not in "AEIOU")):
            w[i] = w[i - 1]
        elif w[i] == "W" and w[i - 1] in "AEIOU":
            w[i] = w[i - 1]
        if w[i] != out[-1]:
            out += w[i]
        i += 1
    if len(out) > 1 and out.endswith("S"):
        out = out[:-1]
    if out.endswith("AY"):
        out = out[:-2] + "Y"
    if len(out) > 1 and out.endswith("A"):
        out = out[:-1]
    return out


def nysiis_text(text: str) -> str:
    """The codes of all words, joined."""
    return "".join(_nysiis(w) for w in text.split())


def _per_text(x: Col, name: str, f) -> Column:
    @F.arrow_udf("string")
    def keyed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([None if v is None else f(v) for v in a.to_pylist()], pa.string())

    return keyed(col(x)).alias(name)


def scorable_slug(x: Col, keep_lead: bool = False) -> Column:
    return _per_text(x, "scorable_slug", lambda v: scorable_text(v, keep_lead))


def nysiis(x: Col) -> Column:
    return _per_text(x, "nysiis", nysiis_text)
