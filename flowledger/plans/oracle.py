"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from ..functions.physics import DENSITY, GRAVITY, IEC_KW, PUMP_TYPES, TYPE_WORDS


def key(x: str = "model") -> str:
    s = f"translate(upper(trim({x})), 'АВЕКМНОРСТХ', 'ABEKMHOPCTX')"
    for pattern, by in ((r"\s*(50|60)\s*HZ\s*$", ""), (r"\s*\(IE[1-4]\)\s*$", ""), (r"(/\d)T$", r"\1"), (r"\s*[-–—]\s*", "-"), (r"\s*/\s*", "/"), (r"[\s_]+", ""), (r"([A-Z])-(\d)", r"\1\2")):
        s = f"regexp_replace({s}, '{pattern}', '{by}', 'g')"
    return s


def series(x: str = "model") -> str:
    return f"upper(regexp_extract(trim({x}), '^([A-ZА-ЯЁa-zа-яё]{{2,6}})', 1))"


def hydraulic(q: str = "q_nom", h: str = "h_nom") -> str:
    return f"({DENSITY}::DOUBLE * {GRAVITY}::DOUBLE * ({q} / 3600.0::DOUBLE) * {h} / 1000.0::DOUBLE)"


def eta(q: str = "q_nom", h: str = "h_nom", p: str = "power_kw") -> str:
    return f"(CASE WHEN {q} > 0 AND {h} > 0 AND {p} > 0 THEN {hydraulic(q, h)} / {p} END)"


SIZES = "[" + ", ".join(f"{x}::DOUBLE" for x in IEC_KW) + "]"


def nearest(p: str = "power_kw") -> str:
    return f"list_min(list_transform({SIZES}, lambda s: {{'apart': abs(s - {p}), 'size': s}})).size"


def estimate(q: str = "q_nom", h: str = "h_nom") -> str:
    shaft = f"({hydraulic(q, h)} / CASE WHEN {q} < 10 THEN 0.55::DOUBLE WHEN {q} < 50 THEN 0.65::DOUBLE ELSE 0.72::DOUBLE END)"
    return f"(CASE WHEN {q} > 0 AND {h} > 0 THEN coalesce(list_filter({SIZES}, lambda s: s >= {shaft})[1], {IEC_KW[-1]}::DOUBLE) ELSE 0.0::DOUBLE END)"


def pump_type(q: str = "q_nom", h: str = "h_nom", p: str = "power_kw", name: str = "model") -> str:
    words = " ".join(f"WHEN {' OR '.join(f'contains(lower({name}), {w!r})' for w in own)} THEN '{kind}'" for kind, own in TYPE_WORDS.items())
    return f"(CASE {words} WHEN {h} < 15 AND {q} < 50 AND {p} < 0.5::DOUBLE THEN 'circulator' WHEN {h} > 200 THEN 'centrifugal_multi' ELSE 'centrifugal_single' END)"


def rule(kind: str, i: int) -> str:
    return f"(CASE {kind} " + " ".join(f"WHEN '{k}' THEN {v[i]}::DOUBLE" for k, v in PUMP_TYPES.items()) + " END)"


def checked(source: str = "entries", name: str = "checked") -> str:
    """CTEs that add eta, kind, reason and adjustment."""
    return f"""{name}_typed AS (SELECT *, {eta()} AS eta, {pump_type()} AS kind, {nearest()} AS near FROM {source}),
{name} AS (SELECT * EXCLUDE (near), CASE WHEN reason <> 'ok' THEN 0.0::DOUBLE ELSE
    CASE WHEN eta < {rule("kind", 2)} * 0.5::DOUBLE THEN -0.25::DOUBLE WHEN eta > {rule("kind", 3)} THEN -0.15::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN kind <> 'circulator' AND power_kw > 0 AND (power_kw / near < 0.75::DOUBLE OR power_kw / near > 1.35::DOUBLE) THEN -0.1::DOUBLE ELSE 0.0::DOUBLE END END AS adjustment
  FROM (SELECT *, CASE WHEN q_nom <= 0 THEN 'no_flow' WHEN h_nom < 0 THEN 'negative_head' WHEN q_nom > {rule("kind", 0)} * 2 THEN 'flow_too_large'
    WHEN h_nom > {rule("kind", 1)} * 2 THEN 'head_too_large' WHEN eta > 0.96::DOUBLE THEN 'efficiency_impossible' WHEN eta < 0.02::DOUBLE THEN 'efficiency_garbage' ELSE 'ok' END AS reason FROM {name}_typed))"""


ORDER = "seq, q_nom, h_nom, confidence"
