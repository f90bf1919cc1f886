"""SQL form of ``functions.stemming.stem``: a chain of tables, one step of the algorithm each."""

from __future__ import annotations

from ..functions.stemming import IRREGULAR, STEP2, STEP3, STEP4

# c / v per letter; y after a consonant is a vowel, so letters are folded from the left
_SHAPE = (
    "list_reduce(list_concat([''], string_split({0}, '')), "
    "lambda s, ch: s || CASE WHEN ch = '' THEN '' WHEN contains('aeiou', ch) OR (ch = 'y' AND s[-1:] = 'c') THEN 'v' ELSE 'c' END)"
)
_N = "length(w)"
_CVC = f"(({_N} >= 3 AND s[-3:] = 'cvc' AND w[-1:] NOT IN ('w', 'x', 'y')) OR ({_N} = 2 AND s = 'vc'))"


def _measure(cut: int | str) -> str:
    """Vowel-consonant pairs of the word without its last ``cut`` letters."""
    base = f"left(s, {_N} - {cut})"
    return f"((length({base}) - length(replace({base}, 'vc', ''))) // 2)"


def _ends(end: str) -> str:
    return f"ends_with(w, '{end}')"


def _base(n: int) -> str:
    return f"left(w, {_N} - {n})"


def _swap(table: list[tuple[str, str]]) -> str:
    cases = []
    for end, new in table:
        cut = len(end) - (end == "logi")  # "logi" measures the base with its l
        cases.append(f"WHEN {_ends(end)} THEN CASE WHEN {_measure(cut)} > 0 THEN {_base(len(end))} || '{new}' ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


def _long_suffix() -> str:
    cases = []
    for end in sorted(STEP4, key=len, reverse=True):
        also = f" AND {_base(3)}[-1:] IN ('s', 't')" if end == "ion" else ""
        cases.append(f"WHEN {_ends(end)} THEN CASE WHEN {_measure(len(end))} > 1{also} THEN {_base(len(end))} ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


def stems(source: str, least: int) -> str:
    """Tables up to ``stems(word, stem)`` for ``source``, a select of one column ``word``; words of
    fewer letters than ``least`` stay as they are."""
    irregular = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in IRREGULAR.items())
    plural = f"""CASE WHEN {_ends("ies")} AND {_N} = 4 THEN {_base(1)} WHEN {_ends("sses")} THEN {_base(2)} WHEN {_ends("ies")} THEN {_base(2)}
      WHEN {_ends("ss")} THEN w WHEN {_ends("s")} THEN {_base(1)} ELSE w END"""
    past = f"""CASE WHEN {_ends("ied")} THEN CASE WHEN {_N} = 4 THEN {_base(1)} ELSE {_base(2)} END
      WHEN {_ends("eed")} THEN CASE WHEN {_measure(3)} > 0 THEN {_base(1)} ELSE w END
      WHEN {_ends("ed")} AND contains(left(s, {_N} - 2), 'v') THEN {_base(2)} WHEN {_ends("ing")} AND contains(left(s, {_N} - 3), 'v') THEN {_base(3)} ELSE w END"""
    cut = f"(NOT {_ends('ied')} AND NOT {_ends('eed')} AND (({_ends('ed')} AND contains(left(s, {_N} - 2), 'v')) OR ({_ends('ing')} AND contains(left(s, {_N} - 3), 'v'))))"
    mend = f"""CASE WHEN NOT cut THEN w WHEN w[-2:] IN ('at', 'bl', 'iz') THEN w || 'e'
      WHEN {_N} > 1 AND w[-1:] = w[-2:-2] AND s[-1:] = 'c' THEN CASE WHEN w[-1:] IN ('l', 's', 'z') THEN w ELSE {_base(1)} END
      WHEN {_measure(0)} = 1 AND {_CVC} THEN w || 'e' ELSE w END"""
    y_to_i = f"CASE WHEN {_ends('y')} AND {_N} > 2 AND left(s, {_N} - 1)[-1:] = 'c' THEN {_base(1)} || 'i' ELSE w END"
    # the letters before a last e decide by their own end
    short = f"(({_N} >= 4 AND s[-4:-2] = 'cvc' AND w[-2:-2] NOT IN ('w', 'x', 'y')) OR ({_N} = 3 AND left(s, 2) = 'vc'))"
    last_e = f"CASE WHEN {_ends('e')} AND ({_measure(1)} > 1 OR ({_measure(1)} = 1 AND NOT {short})) THEN {_base(1)} ELSE w END"
    last_l = f"CASE WHEN {_ends('ll')} AND {_measure(1)} > 1 THEN {_base(1)} ELSE w END"
    steps = [
        (plural, ""), (past, f", {cut} AS cut"), (mend, ""), (y_to_i, ""), (_swap(STEP2), f", {_ends('alli')} AND {_measure(4)} > 0 AS again"),
        (f"CASE WHEN again THEN {_swap(STEP2)} ELSE w END", ""), (_swap(STEP3), ""), (_long_suffix(), ""), (last_e, ""), (last_l, ""),
    ]
    out = [
        f"voc AS MATERIALIZED (SELECT DISTINCT word FROM ({source}))",
        f"st0 AS MATERIALIZED (SELECT word, w, {_SHAPE.format('w')} AS s FROM (SELECT word, lower(word) AS w FROM voc) WHERE length(w) > greatest(2, {least - 1}) AND w NOT IN ({', '.join(repr(k) for k in IRREGULAR)}))",
    ]
    for k, (step, more) in enumerate(steps):
        names = ", cut" if "AS cut" in more else ", again" if "AS again" in more else ""
        out.append(f"st{k + 1} AS MATERIALIZED (SELECT word, w, {_SHAPE.format('w')} AS s{names} FROM (SELECT word, {step} AS w{more} FROM st{k}))")
    out.append(
        f"stems AS MATERIALIZED (SELECT word, w AS stem FROM st{len(steps)} UNION ALL SELECT word, CASE WHEN length(word) < {least} THEN word ELSE CASE lower(word) {irregular} ELSE lower(word) END END FROM voc WHERE word NOT IN (SELECT word FROM st0))"
    )
    return ",\n".join(out)
