"""SQL pieces for text that several oracles share.

DuckDB has no NFKC, but NFC: compatibility characters are taken apart first, by
tables made from unicodedata when this module is loaded.
"""

from __future__ import annotations

import sys
import unicodedata

#: White space spelled out (fixed value): engines differ on \\s.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _compatibility() -> dict[str, str]:
    """Characters whose compatibility form differs from their canonical one."""
    out = {}
    for code in range(0xA0, sys.maxunicode + 1):
        c = chr(code)
        if not 0xAC00 <= code < 0xD7A4 and not 0xD800 <= code < 0xE000 and unicodedata.normalize("NFKD", c) != unicodedata.normalize("NFD", c):
            out[c] = unicodedata.normalize("NFKC", c)
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_FORMS = _compatibility()
_ONE = {a: b for a, b in _FORMS.items() if len(b) == 1}
_MANY = {a: b for a, b in _FORMS.items() if len(b) > 1}
_ANY = "[" + "".join(f"\\x{{{ord(a):x}}}" for a in _MANY) + "]"
_MAP = "MAP([" + ", ".join(map(_quoted, _MANY)) + "], [" + ", ".join(map(_quoted, _MANY.values())) + "])"


def nfkc(c: str) -> str:
    """SQL of the NFKC form of a text expression."""
    parts = f"list_aggregate(list_transform(str_split({c}, ''), lambda ch: coalesce({_MAP}[ch], ch)), 'string_agg', '')"
    taken = f"CASE WHEN regexp_matches({c}, '{_ANY}') THEN {parts} ELSE {c} END"
    return f"nfc_normalize(translate({taken}, {_quoted(''.join(_ONE))}, {_quoted(''.join(_ONE.values()))}))"


def trim(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{WS}+', ''), '{WS}+$', '')"


def plain(c: str) -> str:
    """Without white space."""
    return f"regexp_replace({c}, '{WS}+', '', 'g')"


def form(c: str) -> str:
    """The normal form in which texts are compared: NFKC, without white space."""
    return plain(nfkc(c))


def json_text(c: str) -> str:
    """A string as JSON the way Spark writes it (DuckDB escapes U+007F)."""
    return f"coalesce(replace(to_json({c})::VARCHAR, '\\u007F', chr(127)), 'null')"


def spans(table: str, key: str, text: str, patterns: dict[str, str]) -> str:
    """SQL: (key, kind, start_pos, end_pos, quote) of all matches: what stands between them tells their places."""
    out = []
    for kind, pattern in patterns.items():
        p = pattern.replace("\\d", "\\p{Nd}").replace("'", "''")
        out.append(f"""
SELECT {key}, '{kind}' AS kind, list_sum([0] || list_transform(b[1:i], lambda x: len(x)))::INT + list_sum([0] || list_transform(m[1:i - 1], lambda x: len(x)))::INT AS start_pos,
  list_sum([0] || list_transform(b[1:i], lambda x: len(x)))::INT + list_sum([0] || list_transform(m[1:i], lambda x: len(x)))::INT AS end_pos, m[i] AS quote
FROM (SELECT {key}, b, m, unnest(generate_series(1, len(m))) AS i FROM (SELECT {key}, regexp_split_to_array({text}, '{p}') AS b, regexp_extract_all({text}, '{p}') AS m FROM {table} WHERE regexp_matches({text}, '{p}')))""")
    return "\nUNION ALL ".join(out)
