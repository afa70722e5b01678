"""Operators on literal inputs, odd rows and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from flowledger.operators import codes, columns, curve_tables, extract, fills, match, merge, page_rules, quality, recipes, tables, wordscan
from flowledger.sources import snapshot


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---------------------------------------------------------------- curve tables


def test_lines_of_flows_carry_down(spark):
    text = "PV 1  1.1  9  8  7\nQ (м³/ч): 0 3 4 5 6\nPV(n) 2-6   1.1   H (м)   69  65  53  45  18\nPV(n) 2-7   1,1      82  75  65.5 52  25\nQ l/min\n10  20  30\nX 1-1  3  2  1"
    pages = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no flows  1  2  3  4")], "page int, text string")
    got = {r["model"]: r for r in curve_tables.curves_in_text(pages).collect()}
    assert set(got) == {"PV(n) 2-6", "PV(n) 2-7"}
    first = got["PV(n) 2-6"]
    assert (first["q_points"], first["h_points"], first["power_kw"]) == ([0, 3, 4, 5, 6], [69, 65, 53, 45, 18], 1.1)
    assert (first["q_nom"], first["h_nom"]) == (4.0, 53.0)  # nearest to .65 * 6
    assert curve_tables.curves_in_text(pages.where("false")).count() == 0


def test_flows_of_tables_and_the_first_record_of_a_model(spark):
    cells = [(1, r, c, t) for r, row in enumerate([["Q (m3/h)", "", "0", "5"], ["A 1-1", "2,2", "9", "8"]]) for c, t in enumerate(row)]  # two flows only
    cells += [(2, r, c, t) for r, row in enumerate([["Q (m3/h)", None, "0", "5", "9"], ["A 1-1", "2,2", "9", "8", "7"], ["a 1-1", "", "1", "2", "3"]]) for c, t in enumerate(row)]
    cells = spark.createDataFrame(cells, "table_id int, row_id int, col_id int, text string")
    heads = spark.createDataFrame([(1, 0, "x"), (2, 0, None)], "table_id int, col_id int, text string")
    found = curve_tables.curves_in_tables(cells, heads)
    assert rows(found.select("table_id", "row_id", "model", "power_kw", "q_nom", "h_nom")) == [(2, 1, "A 1-1", 2.2, 5.0, 8.0), (2, 2, "a 1-1", 0.0, 5.0, 2.0)]
    pages = spark.createDataFrame([(7, "n 2900 rpm\nQ m3/h 1 2 3\nB 1-1  9  8  7"), (8, "Q m3/h 1 2 3\nB 1-1  1  9  8  7")], "page int, text string")
    of = spark.createDataFrame([(1, 7), (2, 7)], "table_id int, page int")
    assert rows(curve_tables.curve_records(pages, cells, heads, of).select("page", "model", "rpm")) == [(7, "A 1-1", 2900), (8, "B 1-1", 0)]
    assert curve_tables.curves_in_tables(cells.where("false"), heads).count() == 0


# ---------------------------------------------------------------- fills


def test_a_filled_model_gives_in_the_next_pass(spark):
    own = [("CDM 1-14", 1, 5.0, 6.0, None), ("CDM 1-14-2", 2, 0.0, 0.0, 2.0), ("cdm1-15", 3, 0.0, 0.0, 0.0), ("MATRIX CDM 1-15", 4, 0.0, 0.0, 1.0), (None, 5, 1.0, 1.0, 1.0), ("", 6, 1.0, 1.0, 1.0), ("CDM 1-14", 7, 9.0, 9.0, 9.0)]
    models = spark.createDataFrame(own, "model string, place int, q double, h double, kw double")
    got = {r["model"]: r for r in fills.fill_chain(models).collect()}
    assert set(got) == {"CDM 1-14", "CDM 1-14-2", "cdm1-15", "MATRIX CDM 1-15"}
    assert (got["CDM 1-14"]["kw"], got["CDM 1-14"]["source_kw"], got["CDM 1-14"]["confidence_kw"]) == (2.0, "sibling", 0.4)
    assert (got["cdm1-15"]["q"], got["cdm1-15"]["source_q"]) == (5.0, "neighbor")
    assert (got["MATRIX CDM 1-15"]["h"], got["MATRIX CDM 1-15"]["source_h"], got["MATRIX CDM 1-15"]["source_kw"]) == (6.0, "prefix_dedup", None)
    exchanged = fills.fill_chain(models, (fills.CHAIN[2], fills.CHAIN[0]))
    assert exchanged.where("model = 'cdm1-15'").first()["q"] == 0
    assert fills.fill_chain(models.where("false")).count() == 0


# ---------------------------------------------------------------- columns


def roles_of(spark, *names):
    heads = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "table_id int, col_id int, text string")
    r = columns.column_roles(heads).first()
    return tuple(r[x] for x in columns.ROLES)


def test_roles_exclude_each_other(spark):
    assert roles_of(spark, "Model", "Power kW / head", "Head m", None) == (0, None, 2, 1, None, None)
    assert roles_of(spark, "Model", "A", "B", "L1", "H")[2] is None
    assert roles_of(spark, "Model", "A", "B", "H")[2] == 3
    assert roles_of(spark, "Размеры [мм]", "Q", "H") == (None,) * 6
    assert roles_of(spark, "Model", "Q 1", "Q 2", "Q 3", "Q 4")[1] is None
    empty = spark.createDataFrame([], "table_id int, col_id int, text string")
    assert columns.column_roles(empty).count() == 0
    assert columns.direct_records(spark.createDataFrame([], "table_id int, row_id int, col_id int, text string"), empty).count() == 0


# ---------------------------------------------------------------- templates and extractors


def test_a_template_row_adds_records(spark):
    pages = spark.createDataFrame([(1, "a", "AB 1: 2 kW, CD 3: 4 W"), (2, "b", "AB 1: 2 kW"), (3, None, "AB 1: 2 kW"), (4, "a", None)], "page int, type string, text string")
    one = [("a", "kw", r"([A-Z]+ \d): (\d+) kW", ["model", "power_kw"])]
    more = [*one, ("a", "w", r"([A-Z]+ \d): (\d+) W", ["model", "power_kw"]), ("a", "none", None, ["model"])]
    found = lambda own: rows(extract.template_records(pages, spark.createDataFrame(own, extract.TEMPLATE)).select("page", "template", F.try_element_at("fields", F.lit("model"))))
    assert found(one) == [(1, "kw", "AB 1")]
    assert found(more) == [(1, "kw", "AB 1"), (1, "w", "CD 3")]


def test_extractors_keep_to_the_schema(spark):
    pages = spark.createDataFrame([(1, "list_parser", "TD32-14G/2 8 14 2900 0.75\n"), (2, "other", "TD32-14G/2 8 14")], "page int, type string, text string")
    own = extract.Extractors()
    assert [(r["page"], r["model"], r["rpm"]) for r in own.run(pages).collect()] == [(1, "TD32-14G/2", 2900)]
    assert sorted({r["page"] for r in own.discover(pages).collect()}) == [1, 2]
    with pytest.raises(ValueError, match="already"):
        own.register("list_parser", extract.by_lists)
    own.register("bad", lambda p: p.select("page"))
    with pytest.raises(ValueError, match="bad gives"):
        own.run(pages)


# ---------------------------------------------------------------- codes


@pytest.mark.parametrize(
    ("name", "q", "h", "p", "rpm", "family"),
    [
        ("INL 32-12,5-18-1.1/2", 12.5, 18.0, 1.1, 3000, "INL"), ("MBL 32-160-2.2/4", 6.3, 33.1, 2.2, 1500, "MBL"), ("FVH 6x4/1.5", 6.0, 59.0, 1.5, 0, "FVH"), ("FV 4x8", 4.0, 62.0, 0.0, 0, "FV"), ("FV 5x8", 5.0, 0.0, 0.0, 0, "FV"),
        ("TD 32–14G/2", 12.5, 14.0, 0.0, 0, "TG"), ("FST 40-160/75", 12.5, 0.0, 7.5, 0, "FST"), ("PV(n) 2-6", 2.0, 0.0, 0.0, 0, "PV"), ("CDM​ 32-5", 32.0, 40.0, 0.0, 0, "CDM"), ("CVF 10-4/2,2", 10.0, 23.2, 2.2, 0, "CV"),
        ("EVR(S)15-3", 15.0, 0.0, 0.0, 0, "EVR"), ("250-3", 0.0, 0.0, 0.0, 0, "EVR"), ("Abc 5-60-70/4", 0.0, 0.0, 5.0, 1500, None), ("Other", 0.0, 0.0, 0.0, 0, None), (None, 0.0, 0.0, 0.0, 0, None),
    ],
)
def test_names_of_all_families(spark, name, q, h, p, rpm, family):
    r = codes.decode(spark.createDataFrame([(name, 0.0, 0.0, 0.0, 0)], "model string, q double, h double, p double, rpm int")).first()
    assert (r["q"], r["h"], r["p"], r["rpm"], r["family"]) == (q, h, p, rpm, family)


def test_heads_of_impellers_and_shut_off(spark):
    own = spark.createDataFrame([("32-125.1", 2900), ("32-165", 1450), ("200-250", 1450), ("odd", 2900), (None, 1450)], "kind string, rpm int")
    assert [r["h"] for r in codes.impeller_heads(own, "kind", "rpm").orderBy(F.desc_nulls_last("kind")).collect()] == [20.0, 5.5, 12.5, 3.1, 5.0]
    assert [r[0] for r in spark.createDataFrame([("VO32-120",), ("VO32",), ("VO-0",)], "n string").select(codes.shut_off_head(F.col("n"))).collect()] == [9.4, 0.0, 0.0]


# ---------------------------------------------------------------- outliers, spans, merging


def test_places_without_sorting(spark, monkeypatch):
    monkeypatch.setattr(quality, "RANGES", 4)
    draw = random.Random(2)
    own = [(g, draw.choice([draw.gauss(0, 1), 10.0 ** draw.randrange(-200, 200), 5.0, -3.0])) for g in "ab" for _ in range(300)] + [("c", 1.0)] * 4 + [("d", 7.0)] * 6 + [("d", None)]
    got = {r["g"]: (r["n"], r["p25"], r["p50"], r["p75"]) for r in quality.nearest_rank(spark.createDataFrame(own, "g string, v double"), "g", "v", [25, 50, 75]).collect()}
    want = {}
    for g in "abd":
        v = sorted(x for k, x in own if k == g and x is not None)
        want[g] = (len(v), *(v[min(int(len(v) * p / 100), len(v) - 1)] for p in (25, 50, 75)))
    assert got == want


def test_span_rows_equal_a_walk(spark):
    draw = random.Random(3)
    own = [(p, round(draw.uniform(0, 60), 1), float(draw.randrange(9)), f"t{i}") for p in range(4) for i in range(80)] + [(9, 1.0, 1.0, "alone"), (None, 1.0, 1.0, "x"), (1, None, 1.0, "x")]
    got = {(r["page"], r["text"]): (r["row_no"], r["col_no"]) for r in tables.span_rows(spark.createDataFrame(own, "page int, y double, x double, text string"), ["page"]).collect()}
    want = {}
    for page in {o[0] for o in own if o[0] is not None}:
        spans = sorted((o for o in own if o[0] == page and o[1] is not None), key=lambda o: (o[1], o[2], o[3]))
        grouped, anchor = [], None
        for o in spans:
            if anchor is None or o[1] > anchor + 3.0:
                grouped.append([])
                anchor = o[1]
            grouped[-1].append(o)
        for i, g in enumerate(grouped):
            for k, o in enumerate(sorted(g, key=lambda o: (o[2], o[3]))):
                want[page, o[3]] = (i, k)
    assert got == want


def test_merge_takes_the_curve_of_the_fullest_record(spark):
    own = [(1, "A-1", 5.0, 0.0, 0.0, 0, 0.5, [1.0, 2.0, 3.0], [3.0, 2.0, 1.0], None), (2, "a 1", 0.0, 6.0, 1.0, 2900, 0.9, [1.0], [1.0], "x"), (3, "A1", 7.0, 0.0, 0.0, 0, 0.1, [9.0, 9.0, 9.0], [1.0, 1.0, 1.0], ""), (4, " ", 1.0, 1.0, 1.0, 1, 1.0, None, None, None)]
    df = spark.createDataFrame(own, "seq long, model string, q_nom double, h_nom double, power_kw double, rpm int, confidence double, q_points array<double>, h_points array<double>, article string")
    r = merge.cross_page_merge(df).collect()
    assert len(r) == 1
    assert (r[0]["model"], r[0]["q_nom"], r[0]["h_nom"], r[0]["rpm"], r[0]["article"], r[0]["q_points"], r[0]["confidence"], r[0]["n_pages"]) == ("A-1", 5.0, 6.0, 2900, "x", [1.0, 2.0, 3.0], 0.9, 3)
    assert merge.cross_page_merge(df.where("false")).count() == 0


# ---------------------------------------------------------------- words, pages, snapshots


def test_words_in_texts(spark):
    texts = spark.createDataFrame([(1, "aaaa the cat"), (2, None), (3, "THE"), (4, "")], "id int, body string")
    words = spark.createDataFrame([("aa",), ("the",), ("cat",), ("cat",), ("",), (None,), ("zz",)], "w string")
    assert rows(wordscan.words_in(texts, "body", words)) == [(1, "aa", 2), (1, "cat", 1), (1, "the", 1)]
    assert wordscan.words_in(texts, "body", words.where("false")).count() == 0
    with pytest.raises(ValueError, match="over 2 words"):
        wordscan.words_in(texts, "body", words, most=2)


def test_many_words_make_no_nested_loop(spark):
    pages = spark.createDataFrame([("src1.pdf", f"text word{i} here") for i in range(50)], "source_file string, text string")
    own = spark.range(20_000).select(F.concat(F.lit("r"), "id").alias("recipe_id"), F.lit("src?.pdf").alias("file_pattern"), F.array(F.concat(F.lit("word"), "id")).alias("keywords"), F.array().cast("array<string>").alias("signatures"), F.lit(0.5).alias("confidence"), F.lit(0).alias("failures"))
    found = recipes.match(pages, own, least=100.0)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert rows(found) == [("src1.pdf", "r0", 112.5)]


def test_verification_reads_doubtful_pages_only(spark):
    form = "source_file string, page_num int, model string, q double, h double, kw double, confidence_q double, confidence_h double, confidence_kw double, source_q string, source_h string, source_kw string"
    models = spark.createDataFrame([("f", 1, "AB 1-2", 10.0, 5.0, 0.0, 0.5, 0.9, 0.0, "d", "d", ""), ("f", 2, "AB 1-2", 10.0, 5.0, 1.0, 0.9, 0.9, 0.9, "d", "d", "d"), ("f", 3, "AB", 10.0, 5.0, 1.0, 0.1, 0.1, 0.1, "d", "d", "d")], form)
    texts = spark.createDataFrame([("f", 1, "AB1 -2 12,5 and 5"), ("f", 2, "AB 1-2 99")], "source_file string, page_num int, text string")
    got = {r["page_num"]: (r["q"], r["confidence_q"], r["source_q"], r["confidence_h"]) for r in page_rules.verify_models(models, texts).collect()}
    assert got == {1: (12.5, 0.7, "ocr", 1.0), 2: (10.0, 0.9, "d", 0.9), 3: (10.0, 0.1, "d", 0.1)}


def test_short_names_meet_the_first_of_their_prefix(spark):
    left = spark.createDataFrame([("C",), ("CDM1",), ("",)], "key string")
    right = spark.createDataFrame([(f"CDM{i}", i) for i in range(300)] + [("", 0)], "key string, place int")
    assert rows(match.fuzzy_match(left, right)) == [("C", "CDM0"), ("CDM1", "CDM1")]


def test_a_batch_that_breaks_off_is_not_seen(spark, tmp_path):
    path, form = str(tmp_path / "snap"), "catalog string, x long"
    of = lambda *own: spark.createDataFrame(own, form)
    assert snapshot.read_catalogues(spark, path, form).count() == 0
    assert snapshot.replace_catalogues(of(("a", 1), ("b", 2), (None, 9)), path, 1)
    snapshot.write_rows(of(("a", 7)), path, 2)  # stops between the write and the swap
    assert rows(snapshot.read_catalogues(spark, path, form)) == [("a", 1), ("b", 2)]
    assert snapshot.replace_catalogues(of(("a", 8), ("a", 9)), path, 2)  # the second try
    assert not snapshot.replace_catalogues(of(("a", 0)), path, 2)
    assert rows(snapshot.read_catalogues(spark, path, form)) == [("a", 8), ("a", 9), ("b", 2)]
    assert rows(snapshot.read_catalogues(spark, path, form, version=1)) == [("a", 1), ("b", 2)]
    assert snapshot.replace_catalogues(of(), path, 3) and snapshot.read_catalogues(spark, path, form).count() == 3
