"""Decoded names and heads by rule tables. The tables of the SQL are written out here and not taken from the module under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codes as C
from .inputs import table
from .registry import query

FLOWS = [1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 16, 20, 25, 30, 32, 40, 42, 45, 50, 64, 65, 80, 85, 90, 100, 120, 125, 150, 155, 185, 200, 215, 250, 300, 320, 7]
NAMES = [
    "concat('CDM ', w, '-', s)", "concat('CVF ', w, '-', s, '/1,5')", "concat('INL ', w, '-12,5-18-', s, '/4')", "concat('МВL ', w, '-160A-7.5/4')", "concat('MBL', w, '–125.5')", "concat('FV ', w, 'x', s, '/2.2T')",
    "concat('FVH', w, '×', s)", "concat('TL ', w, '-', s * 15, '/4')", "concat('FSM ', w, '-160/', s * 10)", "concat('PV(n) ', w, '-', s)", "concat('EVR(S)', w, '--', s)", "concat(w, '-', s)", "concat('Xyz ', w, '-', s, '-4.5/2')",
    "concat('TD ', w, '-14-2.2/4')", "concat('fv', w, 'x', s)", "concat('Nothing ', w)", "concat('CDLF ', w, '—', s)",
]
CODED = f"""coded AS (SELECT k, CASE kind {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(NAMES))} END AS model, kind, w, s, CASE WHEN k % 7 = 0 THEN 33.0 ELSE 0.0 END AS q, CASE WHEN k % 11 = 0 THEN 44.0 ELSE 0.0 END AS h, CASE WHEN k % 3 = 0 THEN 9.5 ELSE 0.0 END AS p, CASE WHEN k % 5 = 0 THEN 1450 ELSE 0 END AS rpm
  FROM (SELECT p_partkey AS k, CAST(p_partkey % {len(NAMES)} AS INTEGER) AS kind, CASE CAST(floor(p_partkey / {len(NAMES)}) AS INTEGER) % {len(FLOWS)} {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(FLOWS))} END AS w, CAST(p_partkey % 18 + 1 AS INTEGER) AS s FROM part))"""


def values(name: str, rows: str) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {rows}) v)"


WIDTHS = values("widths(g, w, flow)", """('MBL',32,6.3),('MBL',40,12.5),('MBL',50,25),('MBL',65,50),('MBL',80,50),('MBL',100,100),('MBL',125,160),('MBL',150,200),('MBL',200,400),
('TG',25,6),('TG',32,12.5),('TG',40,20),('TG',50,30),('TG',65,50),('TG',80,80),('TG',100,120),('TG',125,180),('TG',150,250),('TG',200,400),('TG',300,900),
('FST',25,3),('FST',32,6.3),('FST',40,12.5),('FST',50,25),('FST',65,50),('FST',80,50),('FST',100,100),('FST',125,160),('FST',150,200)""")
POINTS = values("points(g, w, s, head)", """('FVH',1,2,17),('FVH',1,3,25),('FVH',1,4,33),('FVH',1,5,40),('FVH',1,6,48),('FVH',2,2,25),('FVH',2,3,36),('FVH',2,4,50),('FVH',2,5,61),('FVH',2,6,71),('FVH',4,2,26),('FVH',4,3,40),('FVH',4,4,53),('FVH',4,5,66),('FVH',4,6,80),
('FVH',6,3,45),('FVH',6,4,59),('FVH',6,5,75),('FVH',6,6,89),('FVH',8,2,20),('FVH',8,3,30),('FVH',8,4,40),('FVH',8,5,50),('FVH',12,2,22),('FVH',12,3,36),('FVH',12,4,51),
('FV',4,7,53),('FV',4,9,68),('FV',4,13,98),('FV',4,16,121),('FV',6,5,36),('FV',6,8,58),('FV',6,11,80),('FV',6,15,109),('FV',8,4,30),('FV',8,7,53),('FV',8,9,68),('FV',8,12,90),('FV',8,16,121),
('FV',12,3,24),('FV',12,5,42),('FV',12,7,59),('FV',12,9,76),('FV',12,12,100),('FV',12,17,145),('FV',30,7,85),('FV',30,9,109),('FV',30,11,134)""")
STAGES = values("stages(g, w, head)", """('FV',4,7.8),('FV',6,7.4),('FV',8,7.7),('FV',12,8.6),('FV',30,12.2),('FVH',1,8.2),('FVH',2,12.2),('FVH',4,13.2),('FVH',6,14.9),('FVH',8,10.0),('FVH',12,11.9),
('CDM',1,18.0),('CDM',2,13.0),('CDM',3,9.5),('CDM',4,8.6),('CDM',5,7.0),('CDM',10,10.0),('CDM',16,8.7),('CDM',20,7.5),('CDM',32,8.0),('CDM',42,7.5),('CDM',65,7.0),('CDM',85,6.5),('CDM',120,5.5),('CDM',150,5.0),('CDM',155,5.0),('CDM',185,4.5),('CDM',200,4.0),('CDM',215,3.8),('CDM',250,3.5),
('CV',1,25.0),('CV',2,15.0),('CV',3,12.0),('CV',4,10.0),('CV',5,8.0),('CV',10,5.8),('CV',15,4.5),('CV',20,4.0),('CV',32,3.2),('CV',45,2.8),('CV',64,2.5),('CV',90,2.2),('CV',120,2.0),('CV',150,1.8),('CV',200,1.5),('CV',320,1.2)""")
FAMILY = "CASE WHEN kind IN (0, 16) THEN 'CDM' WHEN kind = 1 THEN 'CV' WHEN kind = 2 THEN 'INL' WHEN kind IN (3, 4) THEN 'MBL' WHEN kind IN (5, 14) THEN 'FV' WHEN kind = 6 THEN 'FVH' WHEN kind IN (7, 13) THEN 'TG' WHEN kind = 8 THEN 'FST' WHEN kind = 9 THEN 'PV' WHEN kind IN (10, 11) THEN 'EVR' END"
D = lambda x: f"CAST({x} AS DOUBLE)"
TENTH = "floor(({0}) * 10 + 0.5::DOUBLE) / 10"
TIP = "3.141592653589793::DOUBLE * ((CASE kind WHEN 3 THEN 160.0::DOUBLE ELSE 125.5::DOUBLE END) / 1000) * (CASE WHEN rpm = 0 THEN 2900 ELSE rpm END) / 60"


@query(
    "f16_coded_names",
    f"""WITH {CODED}, {WIDTHS}, {POINTS}, {STAGES}, f AS (SELECT *, {FAMILY} AS family FROM coded),
    j AS (SELECT f.*, CAST(flow AS DOUBLE) AS flow, CAST(points.head AS DOUBLE) AS ph, CAST(stages.head AS DOUBLE) AS sh FROM f LEFT JOIN widths ON family = widths.g AND f.w = widths.w LEFT JOIN points ON family = points.g AND f.w = points.w AND f.s = points.s LEFT JOIN stages ON family = stages.g AND f.w = stages.w),
    r AS (SELECT k, model, family, kind, s,
      CASE family WHEN 'INL' THEN 12.5 WHEN 'MBL' THEN coalesce(flow, w * 0.5::DOUBLE) ELSE CASE WHEN q <> 0 THEN q WHEN family IN ('FV', 'FVH', 'PV', 'CDM', 'CV') THEN w WHEN family IN ('TG', 'FST') THEN coalesce(flow, w * 0.5::DOUBLE) WHEN family = 'EVR' AND w <= 200 THEN w ELSE q END END AS q,
      CASE family WHEN 'INL' THEN 18 WHEN 'MBL' THEN {TENTH.format(f'({TIP}) * ({TIP}) / 9.81::DOUBLE * 0.55::DOUBLE')} ELSE CASE WHEN h <> 0 THEN h WHEN family IN ('FV', 'FVH') THEN coalesce(ph, floor(sh * s + 0.5::DOUBLE), h) WHEN kind = 7 AND s * 15 <= 200 THEN s * 15 WHEN kind = 13 THEN 14 WHEN family IN ('CDM', 'CV') THEN coalesce({TENTH.format('sh * s')}, h) ELSE h END END AS h,
      CASE WHEN kind = 2 THEN s WHEN kind = 3 THEN 7.5 WHEN p <> 0 THEN p WHEN kind = 1 THEN 1.5 WHEN kind = 5 THEN 2.2 WHEN kind = 8 THEN CASE WHEN s * 10 > 30 THEN s ELSE s * 10 END WHEN kind = 12 THEN least(4.5, s, w) WHEN kind = 13 THEN least(2.2, w) ELSE p END AS p,
      CASE WHEN kind IN (2, 3) THEN 1500 WHEN kind = 12 THEN 3000 WHEN kind = 13 AND p = 0 THEN 1500 ELSE rpm END AS rpm, p AS p0, q AS q0 FROM j)
    SELECT k, model, family, {D('q')} AS q, {D('h')} AS h, {D('p')} AS p, CAST(CASE WHEN kind = 12 AND q0 <> 0 AND p0 <> 0 THEN CASE WHEN k % 5 = 0 THEN 1450 ELSE 0 END ELSE rpm END AS INTEGER) AS rpm FROM r""",
)
def _(spark, d):
    table(spark, d, "part").createOrReplaceTempView("part")
    coded = spark.sql(f"WITH {CODED} SELECT * FROM coded").selectExpr("k", "model", "CAST(q AS DOUBLE) AS q", "CAST(h AS DOUBLE) AS h", "CAST(p AS DOUBLE) AS p", "rpm")
    return C.decode(coded)


IMPELLERS = "CASE p_partkey % 6 WHEN 0 THEN '32-125' WHEN 1 THEN '40-250.1' WHEN 2 THEN '150-315.2' WHEN 3 THEN concat('70-', p_size + 150) WHEN 4 THEN '200-250' ELSE 'KMG' END"


@query(
    "f17_impeller_heads",
    f"""WITH x AS (SELECT p_partkey, {IMPELLERS} AS kind, CASE p_size % 3 WHEN 0 THEN 1450 WHEN 1 THEN 2900 ELSE 960 END AS rpm, CASE p_partkey % 6 WHEN 0 THEN 12.5::DOUBLE WHEN 1 THEN 50.0::DOUBLE WHEN 2 THEN 80.0::DOUBLE WHEN 3 THEN {TENTH.format('((p_size + 150) / 200.0::DOUBLE) * ((p_size + 150) / 200.0::DOUBLE) * 32.0::DOUBLE')} WHEN 4 THEN 12.5::DOUBLE ELSE 20.0::DOUBLE END AS full_head FROM part)
    SELECT p_partkey, kind, rpm, CASE WHEN rpm = 1450 THEN {TENTH.format('full_head * 0.25::DOUBLE')} ELSE full_head END AS h FROM x""",
)
def _(spark, d):
    table(spark, d, "part").createOrReplaceTempView("part")
    return C.impeller_heads(spark.sql(f"SELECT p_partkey, {IMPELLERS} AS kind, CASE p_size % 3 WHEN 0 THEN 1450 WHEN 1 THEN 2900 ELSE 960 END AS rpm FROM part"), "kind", "rpm")


BM = values("bm(w, head)", "(1,8.0),(3,8.0),(5,7.5),(10,7.0),(15,11.5),(20,12.0),(32,12.5),(45,18.0),(64,19.0),(95,17.0),(125,20.5),(155,22.0),(185,30.0),(215,33.0),(255,35.0)")


@query(
    "f17_stage_heads",
    f"""WITH {BM}, x AS (SELECT p_partkey, p_size AS number, p_partkey % 9 + 1 AS stages FROM part)
    SELECT p_partkey, number, stages, {TENTH.format('stages * coalesce(CAST(head AS DOUBLE), 5.0::DOUBLE)')} AS h, {TENTH.format('stages * CASE WHEN number * 2 <= 5 THEN 8.5::DOUBLE WHEN number * 2 <= 20 THEN 7.0::DOUBLE WHEN number * 2 <= 64 THEN 5.5::DOUBLE ELSE 4.0::DOUBLE END')} AS banded, CASE WHEN p_partkey % 4 = 0 THEN 0.0::DOUBLE ELSE {TENTH.format('(number * 7) / 10.0::DOUBLE * 0.78::DOUBLE')} END AS nominal FROM x LEFT JOIN bm ON number = w""",
)
def _(spark, d):
    own = table(spark, d, "part").selectExpr("p_partkey", "p_size AS number", "p_partkey % 9 + 1 AS stages", "CASE WHEN p_partkey % 4 = 0 THEN concat('VO', p_size) ELSE concat('VO32-', p_size * 7) END AS name")
    out = C.stage_heads(own, "BM", "number", "stages")
    return out.select("p_partkey", "number", "stages", "h", C.banded_head(F.col("number") * 2, F.col("stages")).alias("banded"), C.shut_off_head(F.col("name")).alias("nominal"))
