"""String expressions. Patterns are Java regular expressions; no match gives NULL where the value is extracted."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import quoted_replacement

URL = r"https?://[^\s<>\"]+|www\.[^\s<>\"]+"
_POSIX = {"digit": r"\p{Nd}", "alpha": r"\p{L}", "alnum": r"\p{L}\p{Nd}", "space": r"\s", "punct": r"\p{Punct}", "upper": r"\p{Lu}", "lower": r"\p{Ll}", "blank": r" \t", "xdigit": "0-9A-Fa-f", "cntrl": r"\p{Cntrl}", "word": r"\w"}


def java_regex(pattern: str) -> str:
    """POSIX bracket classes, which Java does not know, as Unicode properties."""
    return re.sub(r"\[:(\w+):\]", lambda m: _POSIX[m[1]], pattern)


def _extract(x: Column, pattern: str, group: int = 0) -> Column:
    return F.when(F.regexp_like(x, F.lit(pattern)), F.regexp_extract(x, pattern, group))


def _inside(begin: str, end: str) -> str:
    b, e = re.escape(begin), re.escape(end)
    body = f"[^{re.escape(begin[-1])}{re.escape(end[0])}]*" if begin != end else f"[^{e}]*"
    return f"{b}({body}){e}"


def str_extract_inside(x: Column, begin: str = "(", end: str = ")", all: bool = False, include_special_chars: bool = True) -> Column:
    p = _inside(begin, end)
    k = 0 if include_special_chars else 1
    return F.regexp_extract_all(x, F.lit(p), k) if all else _extract(x, p, k)


def str_replace_inside(x: Column, begin: str = "(", end: str = ")", rep: str = "", all: bool = False, include_special_chars: bool = True) -> Column:
    rep = rep if include_special_chars else begin + rep + end
    p, r = _inside(begin, end), quoted_replacement(rep)
    return F.regexp_replace(x, p, r) if all else F.regexp_replace(x, f"(?s)^(.*?){p}", "$1" + r)


def str_remove_inside(x: Column, begin: str = "(", end: str = ")", all: bool = False, include_special_chars: bool = True) -> Column:
    return str_replace_inside(x, begin, end, "", all, include_special_chars)


def str_clean(x: Column) -> Column:
    """Trimmed, with runs of white space as one space."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def str_remove(x: Column, pattern: str, remove_extra_space: bool = False) -> Column:
    out = F.regexp_replace(x, "(?s)^(.*?)" + f"(?:{java_regex(pattern)})", "$1")
    return str_clean(out) if remove_extra_space else out


def str_remove_all(x: Column, pattern: str, remove_extra_space: bool = False) -> Column:
    out = F.regexp_replace(x, java_regex(pattern), "")
    return str_clean(out) if remove_extra_space else out


def _placed(pattern: str, position: str) -> str:
    return {"any": pattern, "start": f"^(?:{pattern})", "end": f"(?:{pattern})$"}[position]


def str_remove_url(x: Column, position: str = "any") -> Column:
    return F.regexp_replace(x, _placed(URL, position), "")


def str_replace_url(x: Column, rep: str = "") -> Column:
    return F.regexp_replace(x, URL, quoted_replacement(rep))


def str_extract_url(x: Column, position: str = "any") -> Column:
    return F.regexp_extract_all(x, F.lit(_placed(URL, position)), 0)


def str_extract_word(x: Column, start: int = 1, end: int | None = None, sep: str = " ") -> Column:
    """Words ``start`` to ``end``, counted from 1, or from the end if negative."""
    end = start if end is None else end
    words = F.split(x, re.escape(sep))
    n = F.size(words)
    a = F.lit(start) if start > 0 else n + 1 + start
    b = F.lit(end) if end > 0 else n + 1 + end
    return F.when((a >= 1) & (a <= n), F.array_join(F.slice(words, F.greatest(a, F.lit(1)), F.greatest(F.least(b, n) - a + 1, F.lit(0))), sep))


def str_remove_word(x: Column, start: int = 1, end: int | None = None, sep: str = " ") -> Column:
    return str_replace_word(x, start, end, sep, None)


def str_replace_word(x: Column, start: int = 1, end: int | None = None, sep: str = " ", rep: str | None = "") -> Column:
    end = start if end is None else end
    words = F.split(x, re.escape(sep))
    n = F.size(words)
    a = F.lit(start) if start > 0 else n + 1 + start
    b = F.lit(end) if end > 0 else n + 1 + end
    kept = F.filter(F.transform(words, lambda w, i: F.when((i + 1 == a), F.lit(rep)).when((i + 1 > a) & (i + 1 <= b), F.lit(None)).otherwise(w)), lambda w: w.isNotNull())
    return F.when(x.isNotNull(), F.array_join(kept, sep))


def str_extract_before(x: Column, sep: str = r"\,", include_sep: bool = False) -> Column:
    """Up to the first separator; NULL if there is none."""
    return _extract(x, f"(?s)^(.*?)({sep})", 0 if include_sep else 1)


def str_extract_after(x: Column, sep: str = r"\,", include_sep: bool = False) -> Column:
    return _extract(x, f"(?s)({sep})(.*)$", 0 if include_sep else 2)


def str_replace_before(x: Column, sep: str = r"\,", rep: str = "", include_sep: bool = True) -> Column:
    return F.regexp_replace(x, f"(?s)^.*?({sep})", quoted_replacement(rep) + ("" if include_sep else "$1"))


def str_replace_after(x: Column, sep: str = r"\,", rep: str = "", include_sep: bool = True) -> Column:
    return F.regexp_replace(x, f"(?s)({sep}).*$", ("" if include_sep else "$1") + quoted_replacement(rep))


def str_remove_before(x: Column, sep: str = r"\,", include_sep: bool = True) -> Column:
    return str_replace_before(x, sep, "", include_sep)


def str_remove_after(x: Column, sep: str = r"\,", include_sep: bool = True) -> Column:
    return str_replace_after(x, sep, "", include_sep)


def str_replace_range(x: Column, start: int, end: int = -1, replacement: str = "") -> Column:
    """Characters ``start`` to ``end``, counted from 1 or from the end if negative, replaced."""
    n = F.char_length(x)
    a = F.lit(start) if start > 0 else n + 1 + start
    b = F.lit(end) if end > 0 else n + 1 + end
    head = F.substring(x, F.lit(1), F.greatest(a - 1, F.lit(0)))
    return F.concat(head, F.lit(replacement), F.substring(x, F.least(b, n) + 1, n))


def str_remove_range(x: Column, start: int, end: int = -1) -> Column:
    return str_replace_range(x, start, end, "")


def str_detect(x: Column, pattern: str, negate: bool = False, ignore_case: bool = False) -> Column:
    out = F.regexp_like(x, F.lit(("(?i)" if ignore_case else "") + java_regex(pattern)))
    return ~out if negate else out


def str_count_all(x: Column, patterns: dict[str, str]) -> Column:
    """A map of pattern name to its number of matches."""
    return F.create_map(*[c for k, p in patterns.items() for c in (F.lit(k), F.regexp_count(x, F.lit(java_regex(p))))])


def str_logical(x: Column, true_value: str | list[str] | None = None) -> Column:
    yes = [true_value] if isinstance(true_value, str) else true_value or ["true", "yes", "1", "t", "y", "on"]
    no = ["false", "no", "0", "f", "n", "off"]
    low = F.lower(F.trim(x))
    if true_value is not None:
        return low.isin([v.lower() for v in yes])
    return F.when(low.isin(yes), True).when(low.isin(no), False)


def parse_number(x: Column) -> Column:
    """The first number in a text, group commas allowed."""
    return F.regexp_replace(_extract(x, r"-?\d[\d,]*(?:\.\d+)?|-?\.\d+"), ",", "").try_cast("double")


def extract_numeric(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9.\-]", "").try_cast("double")


def anonymize(x: Column, seed: int = 1) -> Column:
    """A salted SHA-256 digest in hex."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), x.cast("string")), 256)


def recode(x: Column, mapping: dict, default=None, missing=None, keep: bool = True) -> Column:
    """Values by a map; others stay (or become ``default``), NULL becomes ``missing``."""
    out = F.when(x.isNull(), F.lit(missing))
    for k, v in mapping.items():
        out = out.when(x == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default) if default is not None or not keep else x)


def str_normalize(x: Column) -> Column:
    """NFKC, by an Arrow function (Spark has no such expression)."""

    @F.arrow_udf("string")
    def nfkc(values):
        import unicodedata

        import pyarrow as pa

        return pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())

    return nfkc(x)


def is_alphabet(x: Column) -> Column:
    return F.regexp_like(x, F.lit(r"^[A-Za-z]+$"))


def is_digit(x: Column) -> Column:
    return F.regexp_like(x, F.lit(r"^[0-9]+$"))


def is_empty(x: Column) -> Column:
    return x.isNull() | (F.trim(x.cast("string")) == "")
