"""URL rules and cascade against SQL, and templates of benchmark items against a plain version."""

import numpy as np
import pytest

from fieldtally.llm import decontaminate, url_cascade
from fieldtally.llm.queries import ORACLES, QUERIES
from tests.llm.fixtures import DOCUMENTS, SF, awkward, empty, oracle, prose, rows_of, texts_of

ITEMS = "item_id long, text string"


# -- urls ---------------------------------------------------------------------------------------------
def test_url_query_against_sql(spark):
    got = rows_of(QUERIES["op9_bloom_cascade"](spark, SF), "page_id", "host", "path", "rule", "verdict")
    expected = oracle(ORACLES["op9_bloom_cascade"])[["page_id", "host", "path", "rule", "verdict"]]
    rows = [tuple(None if v is None or v != v else v for v in r) for r in expected.itertuples(index=False)]
    assert got == sorted(rows, key=repr)


CASES = [
    ("https://a.org/x?y#z", "a.org", "/x", "org/", "allow"), ("HTTP://WWW.Example.ORG/es/1", "www.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://x.com/fr/a", "x.com", "/fr/a", "com/fr/", "allow"),
    ("http://spam-x.com/fr/a", "spam-x.com", "/fr/a", "com/fr/", "allow"), ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("http://spam-x.net/a", "spam-x.net", "/a", None, "block"), ("http://spamless.net", "spamless.net", "", None, "allow"),
    ("http://org?q=/", "org", "", None, "allow"), ("no host/at all", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("x://a://b/c", "a:", "//b/c", None, "allow"), ("http://ÄÖ.net/É\n/x", "ÄÖ.net", "/É\n/x", None, "allow"),
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(k, c[0], None) for k, c in enumerate(CASES)], "page_id long, url string, html string")
    pages = pages.withColumn("host", pages["url"]).withColumn("verdict", pages["url"])  # clashing names
    got = sorted(map(tuple, url_cascade.judge_pages(pages).collect()))
    assert got == [(k, *c[1:]) for k, c in enumerate(CASES)]
    assert url_cascade.judge_pages(pages.union(pages)).count() == 2 * len(CASES)
    assert url_cascade.judge_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("listed,others", [(0, 100), (1, 0), (1, 10_000), (5_000, 20_000), (900, 100)])
def test_a_cascade_is_exact_on_its_universe(listed, others):
    rng = np.random.default_rng(listed)
    keys = np.unique(rng.integers(0, 2**63, listed + others, dtype=np.uint64))
    rng.shuffle(keys)
    levels = url_cascade.build_levels(keys[:listed], keys[listed:])
    found = url_cascade.contains(keys, levels)
    assert found[:listed].all() and not found[listed:].any()


def test_shards_and_passes(spark, monkeypatch):
    monkeypatch.setattr(url_cascade, "SHARD_KEYS", 20)
    monkeypatch.setattr(url_cascade, "MAX_BYTES", 64)  # a few shards a pass
    keys = [(k * 2654435761 - 2**40, k % 3 == 0) for k in range(1000)]
    universe = spark.createDataFrame(keys, "key_hash long, listed boolean")
    pages = universe.select("key_hash").union(universe.select("key_hash")).union(spark.createDataFrame([(None,)], "key_hash long"))
    got = url_cascade.judged(pages, url_cascade.build(universe), "key_hash")
    truth = dict(keys) | {None: False}
    rows = got.collect()
    assert len(rows) == 2001 and all(r["_listed"] == truth[r["key_hash"]] for r in rows)


# -- benchmark -----------------------------------------------------------------------------------------
def leaks(spark, docs, items, **more):
    frame = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in docs], DOCUMENTS)
    found = decontaminate.leaks(frame, spark.createDataFrame(items, ITEMS), **more)
    return {(r["doc_id"], r["item_id"]): (r["n_windows"], r["item_windows"], r["n_slots"], r["n_changed"]) for r in found.collect()}


QUESTION = "a train leaves the town of Marville with 120 passengers and after 45 minutes 120 more join Marville people on board"


def test_verbatim_and_changed_questions(spark):
    before, after = prose(50, 30), prose(51, 30)
    other = QUESTION.replace("120", "300").replace("Marville", "Bourg").replace("45", "9")
    broken = other.replace("and after 9 minutes 300 more", "and after 9 minutes 301 more")
    docs = [
        (1, f"{before} {QUESTION} {after}"), (2, f"{before} {other.upper().lower()} {after}"), (3, f"{before} {other} {after}"),
        (4, f"{before} {broken} {after}"), (5, before), (6, f"{QUESTION.replace(' ', '  ,  ')}!"), (7, None), (8, ""), (None, QUESTION),
    ]
    found = leaks(spark, docs, [(70, QUESTION), (71, None), (72, "too short"), (None, QUESTION)])
    assert {k for k in found if k[1] == 70} == set(found)
    assert {k[0] for k in found} >= {1, 3, 6, None} and not {k[0] for k in found} & {4, 5, 7, 8}
    assert found[1, 70][2:] == (4, 0) and found[3, 70][2:] == (4, 3) and found[1, 70][0] == found[1, 70][1]


def test_short_and_slot_dense_items_word_for_word(spark):
    before, after = prose(52, 30), prose(53, 30)
    sums, names = "What is 12 plus 15 times 3?", "so Ann, Bob, Carl, Dora, Emil, Finn, Gus, Hal, Ida have 7 8 9"
    docs = [(1, f"{before} {sums} {after}"), (2, f"{before} {sums.replace('15', '16')} {after}"), (3, f"{before} so {names} {after}"),
            (4, f"{before} two plus two {after}"), (5, f"{before} two plus three {after}"), (6, ""), (7, before)]
    found = leaks(spark, docs, [(1, sums), (2, names), (3, "Two plus two?"), (4, ""), (5, " ? ")])
    assert set(found) == {(1, 1), (3, 2), (4, 3)} and found[1, 1] == (1, 1, 3, 0)


def test_partial_short_and_repeated_items(spark):
    item = prose(60, 40)
    words = item.split()
    docs = [(1, " ".join(words[:20])), (2, " ".join(words[:9])), (3, item + " " + item), (4, "six plain words stand right here"),
            (5, "well six plain words stand right here today"), (6, item)]
    found = leaks(spark, docs, [(1, item), (1, item), (2, "Six plain words, stand right here."), (3, item)])
    assert set(found) == {(1, 1), (1, 3), (3, 1), (3, 3), (6, 1), (6, 3), (4, 2), (5, 2)}
    assert found[3, 1] == found[6, 1] == (33, 33, 0, 0) and found[4, 2][:2] == (1, 1)


def test_one_inconsistent_value_takes_out_its_windows_only(spark):
    item = f"{prose(61, 20)} with 120 more {prose(62, 25)} and 120 less {prose(63, 9)}"
    docs = [(1, f"{prose(64, 20)} {item.replace('120 less', '121 less')} {prose(65, 20)}"), (2, item)]
    found = leaks(spark, docs, [(1, item)])
    assert set(found) == {(1, 1), (2, 1)} and found[2, 1][0] == found[2, 1][1]
    assert found[2, 1][1] * 0.25 <= found[1, 1][0] < found[2, 1][1] and found[1, 1][3] == 0


def plain_leaks(docs, items):
    """Verbatim runs of eight words, for texts without slots."""
    import re

    def words(text):
        return re.sub(r"[^\w\s]|_", "", text.lower()).split()

    out = set()
    for item_id, text in items:
        w = words(text)
        runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        for doc_id, body in docs:
            d = words(body)
            here = {tuple(d[i : i + 8]) for i in range(len(d) - 7)}
            if runs and sum(r in here for r in runs) >= len(runs) / 4:
                out.add((doc_id, item_id))
    return out


def test_query_finds_what_a_plain_search_finds(spark):
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op8_template_decontamination"](spark, SF).collect()}
    docs = texts_of(spark.read.parquet(f"{SF}/documents.parquet"))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert got >= plain_leaks(docs, items) and len(got) <= len(plain_leaks(docs, items)) + 2


def test_query_against_sql(spark):
    columns = ["doc_id", "item_id", "n_windows", "item_windows", "n_slots", "n_changed", "evident"]
    got = rows_of(QUERIES["op8_template_decontamination"](spark, SF), *columns)
    expected = oracle(ORACLES["op8_template_decontamination"])[columns]
    assert [tuple(map(int, r)) for r in got] == sorted((tuple(map(int, r)) for r in expected.itertuples(index=False)), key=repr) and got


MID = "Paris hosts three big museums near the river"
CAPITAL = "What is the capital city of the small island state Malta in summer?"
PLANTED_ITEMS = [(1, MID), (2, CAPITAL), (3, "Yes"), (4, "What is 12 plus 15 times 3?"), (5, "Two plus two"), (6, QUESTION), (7, "so 7 8 9, Ann, Bob, Cy 4"),
                 (8, None), (9, " ?! "), (10, "Yes, Yes"), (6, QUESTION)]
PLANTED = [
    (1, "As the guide said, Paris hosts three big museums near the river in spring"), (2, "He asked What is the capital city of the small island state Malta in summer"),
    (3, "yes and yes"), (4, "Yes"), (5, "What is 12 plus 15 times 3?"), (6, "what is 12 plus 16 times 3"), (7, "well two plus two, is four"),
    (8, QUESTION.replace("120", "300")), (9, QUESTION.replace("Marville", "Bourg", 1)), (10, "we have so 7 8 9, ann, bob, cy 4"), (11, None), (12, ""),
    (13, "PARIS HOSTS THREE BIG MUSEUMS NEAR THE RIVER"), (14, "paris hosts four big museums near the river"), (15, "no " * 40), (15, "yes yes"),
] + [(100 + n, f"{prose(n, 12)} yes") for n in range(40)]


def test_planted_cases_against_sql(spark):
    """Copies behind a comma or a small letter, short items, a word that many texts hold: the same rows as SQL gives."""
    import duckdb
    import pandas as pd

    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in PLANTED], DOCUMENTS)
    columns = ["doc_id", "item_id", "n_windows", "item_windows", "n_slots", "n_changed", "evident"]
    found = decontaminate.leaks(docs, spark.createDataFrame(PLANTED_ITEMS, ITEMS))
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(PLANTED, columns=["doc_id", "text"]))
    db.register("benchmark", pd.DataFrame(PLANTED_ITEMS, columns=["item_id", "text"]))
    got = rows_of(found, *columns)
    assert got == sorted((tuple(r) for r in db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['op8_template_decontamination']})").fetchall()), key=repr)
    pairs = {(r[0], r[1]): r[6] for r in got}
    assert {p for p, evident in pairs.items() if evident} >= {(1, 1), (13, 1), (2, 2), (5, 4), (7, 5), (8, 6), (10, 7)}
    assert not {(14, 1), (6, 4)} & set(pairs) and all(not pairs[n, 3] for n in (3, 4, 100, 139))
    kept = {r["doc_id"] for r in decontaminate.drop_leaking(docs, spark.createDataFrame(PLANTED_ITEMS, ITEMS)).select("doc_id").collect()}
    assert kept >= {3, 4, 6, 11, 12, 14, *range(100, 140)} and not kept & {1, 2, 5, 7, 8, 10, 13}


def test_one_scan_for_all_sizes(spark):
    items = [(n, " ".join(prose(70, 30).split()[:n])) for n in range(1, 9)]
    seen = []
    staged = decontaminate.staged

    def watched(frame, label):
        if label == "benchmark-hits":
            seen.append(frame._jdf.queryExecution().executedPlan().toString())
        return staged(frame, label)

    decontaminate.staged = watched
    try:
        decontaminate.leaks(spark.read.parquet(f"{SF}/documents.parquet"), spark.createDataFrame(items, ITEMS))
    finally:
        decontaminate.staged = staged
    assert seen and seen[0].count("documents.parquet") == 1


def test_awkward_and_dropping(spark):
    docs = awkward(spark)
    items = spark.createDataFrame([(1, prose(2, 80)), (2, prose(3, 120))], ITEMS).selectExpr("*", "1 AS hash", "2 AS words")
    bad = {r["doc_id"] for r in decontaminate.leaks(docs, items).collect()}
    assert bad == {1, 2, 8, 9, 12, None}
    kept = decontaminate.drop_leaking(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [3, 4, 5, 6, 7, 10, 10, 11]
    assert kept.where("doc_id IS NULL").count() == 1  # the row without a text leaks nothing
    assert decontaminate.leaks(empty(spark), items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.drop_leaking(docs, items.limit(0)).count() == docs.count()


def test_the_plan_runs_no_python(spark):
    plan = decontaminate.leaks(
        spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    )._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
