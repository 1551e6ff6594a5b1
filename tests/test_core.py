import random

from pyspark.sql import functions as F

from scriptorium.operators import corpus, graph, hierarchy, learning, reasoning, store, structure
from scriptorium.operators.components import connected_components
from scriptorium.operators.prefix import grouped_prefix_sums
from scriptorium.plans import store_queries as q
from scriptorium.runtime import key_filter
from scriptorium.streaming import events as stream


def test_prefix_sums_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.randint(1, 9)) for i in range(300)]
    got = {(r.g, r.o): r.before for r in grouped_prefix_sums(spark.createDataFrame(rows, "g string, o int, v int"), ["g"], ["o"], "v", "before").collect()}
    assert got == {(g, o): sum(v for h, p, v in rows if h == g and p < o) for g, o, _ in rows}


def test_prefix_sums_of_nothing(spark):
    assert grouped_prefix_sums(spark.createDataFrame([], "g string, o int, v int"), ["g"], ["o"], "v", "s").count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    df = spark.createDataFrame([*pairs, (None, 3)], "a int, b int")
    assert {r.node: r.component for r in connected_components(df).collect()} == {x: find(x) for p in pairs for x in p}


def test_key_filter_never_misses(spark):
    keys = spark.range(0, 500, 7).select(F.col("id").cast("string").alias("k"))
    inside = key_filter(keys, "k", bits=4096)
    kept = {r.id for r in spark.range(500).filter(inside(F.col("id").cast("string"))).collect()}
    assert set(range(0, 500, 7)) <= kept and len(kept) < 250
    assert spark.range(10).filter(key_filter(keys.limit(0), "k")(F.col("id").cast("string"))).count() == 0


CONCEPTS = [
    ("r", None, 1), ("a ", "R", 1), ("B", "\ta", 1), ("b", "x", 0), ("o", "gone", 1), ("p", "o", 1), ("s", "s", 1), ("c1", "c2", 1), ("c2", "c1", 1), ("t", "c1", 1), ("", "r", 1), (None, "r", 1), ("r", None, 1), ("e", "  ", 2),
]


def _concepts(spark, rows=CONCEPTS):
    df = spark.createDataFrame(rows, "id string, parent string, updated_at int")
    return df.withColumns({c: F.lit("clash") for c in ("concept_id", "jump", "root", "depth", "size", "path", "lft")})


def test_states_of_nodes(spark):
    got = {(r.concept_id, r.state) for r in hierarchy.lost_nodes(_concepts(spark)).collect()}
    assert got == {("o", "orphan"), ("p", "orphan"), ("s", "cycle"), ("c1", "cycle"), ("c2", "cycle"), ("t", "below_cycle")}
    assert hierarchy.lost_nodes(_concepts(spark).limit(0)).count() == 0


def test_nested_sets_of_random_forest(spark):
    rng = random.Random(9)
    rows = [(f"n{i:03d}", f"n{rng.randint(0, i - 1):03d}" if i % 40 else None, 1) for i in range(1, 200)] + [(f"k{i:02d}", f"k{i + 1:02d}", 1) for i in range(60)]
    parent = {i: p for i, p, _ in rows}

    def up(i):
        out = [i]
        while parent.get(out[0]) in parent:
            out.insert(0, parent[out[0]])
        return out

    ranges = hierarchy.nested_sets(spark.createDataFrame(rows, "id string, parent string, updated_at int"))
    got = {r.concept_id: r for r in ranges.collect()}
    for i in parent:
        assert got[i].path == "/".join(up(i)) and got[i].depth == len(up(i)) - 1 and got[i].root == up(i)[0]
        inside = {j for j in parent if got[i].lft < got[j].lft <= got[i].rgt}
        assert inside == {j for j in parent if i in up(j)[:-1]} and got[i].descendants == len(inside)
    below = hierarchy.descendants_of(ranges, ranges.filter("concept_id like '%5'"), width=8).collect()
    assert {(r.ancestor_id, r.concept_id) for r in below} == {(i, j) for j in parent for i in up(j)[:-1] if i.endswith("5")}


def test_reports_are_split(spark):
    got = {r.raw: r for r in q.report_splits(spark, None).collect()}
    first = got[q.REPORTS[0]]
    assert first.number == "[ 29214 ] 1 ـ" and first.isnad.endswith("( عليه السلام )") and first.matn.startswith("قال سألته") and first.confidence == 0.85
    assert got[q.REPORTS[1]].matn == "الماء كله طاهر حتى يعلم أنه قذر" and got[q.REPORTS[1]].confidence == 0.7
    assert got[q.REPORTS[2]].confidence == 0.3 and got[""].confidence == 0.0
    assert got[q.REPORTS[4]].isnad == "وبإسناده عن سعد بن عبد الله" and got[q.REPORTS[4]].confidence == 0.55


def test_chain_names_and_imam(spark):
    r = spark.createDataFrame([("محمد بن يعقوب ، عن علي بن إبراهيم ، عن أبيه ، عن أبي جعفر ( عليه السلام )",), (None,)], "isnad string")
    rows = r.select(structure.chain_names(F.col("isnad")).alias("n"), structure.identify_imam(F.col("isnad")).alias("i")).collect()
    assert rows[0].n == ["محمد بن يعقوب", "علي بن إبراهيم", "أبيه"] and rows[0].i == "أبي جعفر" and rows[1].n == []


def test_names_are_resolved(spark):
    forms = spark.createDataFrame([("n1", "أحمد بن محمد", "أحمد بن محمد"), ("n1", "أبو جعفر", "أحمد بن محمد"), ("n2", "أبو جعفر", "علي بن محمد"), ("n3", "محمد بن عيسى بن سعد", "محمد بن عيسى بن سعد")], "id string, form string, canonical string")
    names = spark.createDataFrame([("وعن احمد بن محمد",), ("أبو جعفر",), ("محمد بن عيسى الأشعري سعد",), ("زيد",), ("",)], "name string")
    got = {r.name: (r.resolution, r.id) for r in reasoning.resolve_names(names, forms).collect()}
    assert got == {"وعن احمد بن محمد": ("exact", "n1"), "أبو جعفر": ("ambiguous", None), "محمد بن عيسى الأشعري سعد": ("fuzzy", "n3"), "زيد": ("unresolved", None), "": ("unresolved", None)}


def test_names_of_hot_words_are_not_compared_pair_by_pair(spark):
    import time

    ids = [f"n{i}" for i in range(20000)]
    forms = spark.createDataFrame([(i, f"محمد علي س{i}", f"محمد علي س{i}") for i in ids] + [("far", " ".join(f"ط{k}" for k in range(13)), "")], "id string, form string, canonical string")
    names = spark.createDataFrame([(f"محمد علي ص{i}",) for i in ids] + [(" ".join(f"ط{k}" for k in range(8)),), ("محمد زيد ص",)], "name string")
    began = time.time()
    got = {r.name: (r.resolution, r.id, r.confidence) for r in reasoning.resolve_names(names, forms).collect()}
    assert time.time() - began < 40
    best = ("fuzzy", max(ids, key=lambda i: (i[::-1], i)), 0.6667)
    assert got == {f"محمد علي ص{i}": best for i in ids} | {" ".join(f"ط{k}" for k in range(8)): ("fuzzy", "far", 0.6154), "محمد زيد ص": ("unresolved", None, 0.0)}


def test_conflicts_of_sayings(spark):
    said = [(1, *x) for x in q.SAYINGS] + [(2, 7, "عن أبي جعفر يجب الغسل يوم العيد الكبير"), (2, 8, "عن الرضا لا يجب الغسل يوم العيد الكبير 3"), (3, 9, q.SAYINGS[0][1]), (3, None, None)]
    found = reasoning.conflicts(spark.createDataFrame(said, "query_id int, id int, text string"))
    got = {(r.query_id, r.left_id, r.right_id, r.type): [(h.kind, h.confidence) for h in r.reconciliations] for r in found.collect()}
    # The third question has the first's opposite of no text of its own.
    assert got == {
        (1, 2, 1, "negation"): [("general_specific", 0.55)], (1, 3, 4, "purity"): [("different_case", 0.35)],
        (2, 7, 8, "obligation"): [("absolute_restricted", 0.45), ("different_case", 0.4), ("taqiyya", 0.2)],
    }
    assert {(r.type, r.conflicts, r.with_suggestion) for r in reasoning.conflict_report(found).collect()} == {("negation", 1, 1), ("purity", 1, 1), ("obligation", 1, 1)}


def test_smoothing_and_error(spark):
    rng = random.Random(1)
    obs = [(c, rng.random() < 0.65 * c) for c in (rng.random() for _ in range(600))]
    bins = learning.calibration_bins(spark.createDataFrame(obs, "confidence double, correct boolean"))
    raw = [(r.bin, r.observed, r["count"]) for r in bins.orderBy("bin").collect()]
    want = [list(x) for x in raw]
    for i in range(1, len(want)):
        if want[i][1] < want[i - 1][1]:
            v = (want[i][1] * want[i][2] + want[i - 1][1] * want[i - 1][2]) / (want[i][2] + want[i - 1][2])
            want[i][1] = want[i - 1][1] = v
    got = [(r.bin, r.observed) for r in learning.smoothed(bins).orderBy("bin").collect()]
    assert [b for b, _ in got] == [x[0] for x in want] and all(abs(a - x[1]) < 1e-9 for (_, a), x in zip(got, want))
    assert learning.calibration_error(bins).first().ece > 0.05
    assert learning.calibration_error(bins.limit(0)).first().ece == 0.0


def test_ranker_stays_bounded():
    w = learning.train_ranker([({"sig_coverage": 1.0}, {"sig_coverage": 0.1, "layout": 5.0})] * 20)
    assert w["sig_coverage"] > 0 > w["layout"] and max(map(abs, w.values())) <= 0.03
    assert not any(learning.train_ranker([]).values())


def test_upsert_and_regressions(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d"), (None, "m")], "k int, v string")
    assert {tuple(r) for r in store.upsert(old, new, "k").collect()} == {(1, "a"), (2, "c"), (3, "d"), (None, "m")}
    m = spark.createDataFrame([("recall", 0.5), ("latency", 9.0), ("new", 1.0)], "metric string, value double")
    b = spark.createDataFrame([("recall", 0.6), ("latency", 8.0)], "metric string, value double")
    assert {r.metric for r in learning.regressions(m, b, ["latency"]).filter("worse").collect()} == {"recall", "latency"}


def test_concepts_in_texts(spark):
    c = spark.createDataFrame([("c1", "ماء البحر"), ("c2", "الوضوء"), ("c3", None)], "id string, label string")
    t = spark.createDataFrame([(1, "حكم الوضوء من ماء البحر"), (2, "الوضوءات"), (3, None)], "text_id int, text string")
    assert {tuple(r) for r in graph.concepts_in_texts(c, t).collect()} == {(1, "c1"), (1, "c2")}


def test_synonyms_and_long_terms_are_found(spark):
    c = spark.createDataFrame([("c1", "prayer", ["the five daily acts of worship"]), ("c2", "a term of six long words", None)], "id string, label string, synonyms array<string>")
    t = spark.createDataFrame([(1, "of the five daily acts of worship"), (2, "here a term of six long words stands"), (3, "daily acts")], "text_id long, text string")
    assert {tuple(r) for r in graph.concepts_in_texts(c, t).collect()} == {(1, "c1"), (2, "c2")}
    assert graph.concepts_in_texts(c.limit(0), t).count() == 0


def test_current_elements_take_the_latest(spark):
    rows = [(1, "x", "2020-01-01"), (1, "y", "2021-01-01"), (1, "y", "2021-01-01"), (2, "z", None)]
    df = spark.createDataFrame(rows, "element_id int, element_type string, updated_at string").withColumn("updated_at", F.to_timestamp("updated_at"))
    assert {(r.element_id, r.element_type) for r in corpus.current_elements(df).collect()} == {(1, "y"), (2, "z")}


def _events(spark, folder, n, at):
    rows = [(at + i, at + i, 1, "view", 1.0, "{}") for i in range(n)]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
    df.select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(folder)


def test_stream_windows_and_upsert(spark, tmp_path):
    folder = str(tmp_path / "in")
    _events(spark, folder, 50, 0)
    _events(spark, folder, 50, 40)
    s = stream.event_stream(spark, folder)
    query = stream.tumbling(s, "1 minute", late="1 hour").writeStream.outputMode("complete").format("memory").queryName("win").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.n for r in spark.table("win").collect()) == [30, 70]
    up = stream.keep_latest(s, str(tmp_path / "table"), str(tmp_path / "ck")).start()
    up.processAllAvailable()
    up.stop()
    assert stream.latest(spark, str(tmp_path / "table")).count() == 90
    stream.compact(spark, str(tmp_path / "table"), str(tmp_path / "compact"))
    assert stream.latest(spark, str(tmp_path / "compact")).count() == 90
    log = stream.append_log(s, str(tmp_path / "log"), str(tmp_path / "ck2")).start()
    log.processAllAvailable()
    log.stop()
    assert spark.read.json(str(tmp_path / "log")).count() == 100
