"""Porter's suffix stripping (1980) over a table of distinct words, as DuckDB SQL.

One sub-select a step. The conditions on a stem are patterns of consonant runs C and vowel runs V: m > 0 is
``[C]VC``, m = 1 ``[C]VC[V]`` to the end, m > 1 ``[C]VCVC``. A leading y, a consonant, stands as Y meanwhile.
"""

from __future__ import annotations

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_has = lambda pattern: lambda s: f"regexp_matches({s}, '{pattern}')"
_above_0, _above_1 = _has(f"^({_C})?{_V}{_C}"), _has(f"^({_C})?{_V}{_C}{_V}{_C}")
_just_1, _vowel, _short = _has(f"^({_C})?{_V}{_C}({_V})?$"), _has(f"^({_C})?[aeiouy]"), _has(f"^{_C}[aeiouy][^aeiouwxy]$")

# fixed values: suffixes of steps 2 to 4 of the published algorithm
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
          ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
          ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

_cut = lambda n: f"left(w, length(w) - {n})"
_when = lambda pairs, other="w": "CASE " + " ".join(f"WHEN {c} THEN {e}" for c, e in pairs) + f" ELSE {other} END"
_ends = lambda suffix: f"suffix(w, '{suffix}')"


def _swap(rules) -> str:
    return _when([(_ends(s), _when([(_above_0(_cut(len(s))), f"{_cut(len(s))} || '{r}'")])) for s, r in rules])


def _drop(s: str) -> str:
    stem = _cut(len(s))
    return _when([(_above_1(stem) + (f" AND regexp_matches({stem}, '[st]$')" if s == "ion" else ""), stem)])


_STEPS = [
    (_when([(_ends("sses"), _cut(2)), (_ends("ies"), _cut(2)), (_ends("ss"), "w"), (_ends("s"), _cut(1))]), "false"),
    (_when([(_ends("eed"), _when([(_above_0(_cut(3)), _cut(1))])), (f"{_ends('ed')} AND {_vowel(_cut(2))}", _cut(2)),
            (f"{_ends('ing')} AND {_vowel(_cut(3))}", _cut(3))]),
     f"NOT {_ends('eed')} AND ({_ends('ed')} AND {_vowel(_cut(2))} OR {_ends('ing')} AND {_vowel(_cut(3))})"),
    (_when([("NOT bare", "w"), ("regexp_matches(w, '(at|bl|iz)$')", "w || 'e'"),
            ("right(w, 1) = left(right(w, 2), 1) AND length(w) > 1 AND regexp_matches(w, '[^aeiouylsz]$|[^aeiouy]yy$')", _cut(1)),
            (_short("w"), "w || 'e'")]), "false"),
    (_when([(f"{_ends('y')} AND {_vowel(_cut(1))}", f"{_cut(1)} || 'i'")]), "false"),
    (_swap(STEP_2), "false"), (_swap(STEP_3), "false"),
    (_when([(_ends(s), _drop(s)) for s in STEP_4]), "false"),
    (_when([(f"{_ends('e')} AND ({_above_1(_cut(1))} OR {_just_1(_cut(1))} AND NOT {_short(_cut(1))})", _cut(1))]), "false"),
    (_when([(f"{_ends('ll')} AND {_above_1('w')}", _cut(1))]), "false"),
]


def stems_sql(words: str) -> str:
    """SELECT of (word, stem) from a table or sub-select with the column ``word``."""
    lead = lambda a, b: f"CASE WHEN left(w, 1) = '{a}' THEN '{b}' || substr(w, 2) ELSE w END"
    q = f"SELECT word, {lead('y', 'Y')} AS w, false AS bare FROM (SELECT word, word AS w FROM {words})"
    for value, bare in _STEPS:
        q = f"SELECT word, {value} AS w, {bare} AS bare FROM ({q})"
    return f"SELECT word, CASE WHEN length(word) <= 2 THEN word ELSE {lead('Y', 'y')} END AS stem FROM ({q})"
