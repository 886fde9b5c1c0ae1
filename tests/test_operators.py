"""Operators against brute force and hand-made cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomark.operators import citations as ci
from foliomark.operators import detectors as de
from foliomark.operators import fusion, graph, paraphrase, store, writing
from foliomark.operators import similarity as si

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def texts(seed, n=12, length=60):
    random.seed(seed)
    base = [random.choice(WORDS) for _ in range(length)]
    out = []
    for i in range(n):
        t = list(base) if i % 3 == 0 else [random.choice(WORDS) for _ in range(length)]
        for _ in range(i):
            t[random.randrange(length)] = random.choice(WORDS)
        out.append((i, " ".join(t)))
    return [*out, (97, None), (98, ""), (99, out[0][1])]


def gram_set(t, n):
    w = (t or "").split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("least", [0.3, 0.8])
def test_jaccard_join_is_exact(spark, least):
    rows = texts(1)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.class_a, r.class_b) for r in si.jaccard_join(df, least, 3).collect()}
    sets = {i: gram_set(t, 3) for i, t in rows if gram_set(t, 3) and i != 99}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
    assert got == want


def test_token_runs_match_dynamic_programming(spark):
    rows = texts(2, 6, 40)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.other, r.start_a, r.start_b, r.length) for r in si.token_runs(df, df.select(F.col("doc_id").alias("other"), "text"), 4, "doc_id", "other").collect()}
    want = set()
    for i, a in rows:
        for j, b in rows:
            x, y = (a or "").split(), (b or "").split()
            for p in range(len(x)):
                for q in range(len(y)):
                    if x[p] == y[q] and not (p and q and x[p - 1] == y[q - 1]):
                        k = 0
                        while p + k < len(x) and q + k < len(y) and x[p + k] == y[q + k]:
                            k += 1
                        if k >= 4:
                            want.add((i, j, p, q, k))
    assert got == want


def test_jaro_winkler_values():
    assert si.jaro_winkler_value("abcd", "axyz") == pytest.approx(0.55)
    assert si.jaro_winkler_value("martha", "marhta") == pytest.approx(0.961111, abs=1e-5)
    assert si.jaro_winkler_value("", "a") == 0 and si.jaro_winkler_value("", "") == 1


@pytest.mark.parametrize("least", [0.75, 0.6])
def test_sentence_match_loses_nothing(spark, least):
    random.seed(5)
    left = [(i, " ".join(random.choice(WORDS) for _ in range(8))) for i in range(40)]
    right = [(i, " ".join(random.sample(t.split(), 8)) if i % 2 else t.replace("alpha", "omega")) for i, t in left]
    a, b = (spark.createDataFrame(x, "id bigint, sentence string") for x in (left, right))
    got = {r.left_id: (r.right_id, round(r.score, 9)) for r in si.best_sentence_match(a, b, least).collect()}
    want = {}
    for i, s in left:
        best = None
        for j, t in right:
            x, y = set(s.split()), set(t.split())
            score = 0.6 * len(x & y) / len(x | y) + 0.4 * si.jaro_winkler_value(s, t)
            if score >= least and (best is None or score > best[1] + 1e-12):
                best = (j, score)
        if best:
            want[i] = (best[0], round(best[1], 9))
    assert got == want


def test_nearest_and_pairs(spark):
    random_ = np.random.default_rng(3)
    v = random_.normal(size=(80, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in row], i % 4) for i, row in enumerate(v)] + [(900, None, 1)], "vec_id bigint, embedding array<double>, label int")
    got = {(r.query_id, r["rank"]): r.id for r in si.nearest(df.filter("vec_id % 10 = 0"), df, 3, block_rows=3).collect()}
    assert got == {(r.query_id, r["rank"]): r.id for r in si.nearest(df.filter("vec_id % 10 = 0"), df, 3, block_rows=17).collect()}
    s = v @ v.T
    for i in range(0, 80, 10):
        order = [j for j in np.lexsort((np.arange(80), -s[i])) if j != i][:3]
        assert [got[(i, k + 1)] for k in range(3)] == order
    pairs = {(r.a, r.b) for r in si.pairs_above(df, 0.5, rows_per_tile=16).collect()}
    assert pairs == {(i, j) for i in range(80) for j in range(i + 1, 80) if s[i, j] >= 0.5}
    across = {(r.a, r.b) for r in si.pairs_above(df, 0.5, label_col="label", rows_per_tile=16).collect()}
    assert across == {(a, b) for a, b in pairs if a % 4 != b % 4}
    assert si.nearest(df.limit(0), df, 3).count() == 0


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (6, 4), (7, 7), (8, None), (20, 19), (19, 18), (18, 20)] + [(i, i + 1) for i in range(100, 160)]
    got = dict(graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 18: 18, 19: 18, 20: 18} | {i: 100 for i in range(100, 161)}
    assert got == want
    assert graph.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_citations(spark):
    text = "As in [1,3] and [5-7] or [4-2] and (Smith, 2020).\nReferences\n[1] Smith, J. (2019). A long title here. Nature, 3.\ncontinued line\n\n[2] Doe, A. (2031). Other.\nshort"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    cited = {(r.number, r.times) for r in ci.citation_numbers(df).collect()}
    assert cited == {(1, 2), (2, 1), (3, 1), (5, 1), (6, 1), (7, 1)}
    entries = [r.entry for r in ci.references_section(df).orderBy("entry_index").collect()]
    assert entries == ["[1] Smith, J. (2019). A long title here. Nature, 3. continued line", "[2] Doe, A. (2031). Other. short"]
    placed = ci.placed_citations(df).collect()
    assert [(r.kind, r.raw) for r in placed][:3] == [("numeric", "[1,3]"), ("numeric", "[5-7]"), ("numeric", "[4-2]")] and placed[0].position == 6
    scored = ci.reference_scores(ci.references_section(df), 2024, ("doc_id", "entry_index"), "entry").orderBy("entry_index").collect()
    assert scored[1].year_score == 0.5 and scored[0].year_score == 0
    claims = spark.createDataFrame([(1, "Recent studies show that the effect is true. Studies show this clearly in most cases [1]. Nothing.")], "doc_id bigint, text string")
    assert [r.matched for r in ci.uncited_claims(claims).collect()] == ["studies show"]


def test_paraphrase(spark):
    df = spark.createDataFrame([("The big study shows results", "a large research shows results"), ("We found it", "It was found"), ("", "")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    r = df.select(paraphrase.synonym_density(a, b).alias("s"), paraphrase.voice_changed(a, b).alias("v"), paraphrase.word_order_change(a, b).alias("o"), paraphrase.structure_similarity(a, b).alias("t"), paraphrase.paraphrase_score(a, b).alias("p")).collect()
    assert r[0].s == pytest.approx(2 / 5) and r[1].v and r[2].s == 0 and r[2].t == 0 and r[2].p == 0 and 0 <= r[0].o <= 1


def test_writing(spark):
    text = "The method works well. The method is good. The method is fine. The method is old. The method is new. Furthermore it is robust."
    df = spark.createDataFrame([(1, text * 3), (2, None), (3, "short")], "doc_id bigint, text string")
    r = {x.doc_id: x for x in writing.writing_signals(df).collect()}
    assert r[1].phrases == 2 and r[2].level == "INCONCLUSIVE" and r[3].overall == 0
    f = {x.doc_id: x for x in writing.style_fingerprint(df).collect()}
    assert f[2].word_count == 0 and f[1].sentence_count > 5 and 0 < f[1].richness < 1


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "k string, v int, c double")
    new = spark.createDataFrame([("b", 2, 3.0), ("c", 1, 4.0)], "k string, v int, c double")
    assert s.read("t") is None
    s.merge("t", old, ["k"], [F.desc("v")])
    s.merge("t", new, ["k"], [F.desc("v")])
    assert sorted(map(tuple, s.read("t").collect())) == [("a", 1, 1.0), ("b", 2, 3.0), ("c", 1, 4.0)]
    s.append("t", new)
    assert s.read("t").count() == 5
    parent, children = store.cascade_delete(old, {"x": new}, old.filter("k = 'b'"), "k")
    assert parent.count() == 1 and children["x"].count() == 1
    s.reset("t")
    assert s.read("t") is None


def test_fusion(spark):
    rows = [("f1", 1, "exact_copy", "high", 0.9, "", None), ("f2", 1, "semantic_similarity", "low", None, "", "{}"), ("f3", 2, "style_deviation", "low", 0.4, "", "{}"), ("f4", 2, "citation_issue", "low", 0.4, "Missing entries", "{}"), ("f5", 2, "citation_issue", "low", 0.4, "Unused", "{}"), ("f6", 2, "ai_writing", "low", 0.4, "", '{"overall_level": "HIGH"}'), ("f7", 2, "collusion", "low", 0.4, "", '{"clusters": [[1, 2], [3]]}'), ("f8", 1, "source_match", "low", 0.5, "", "{}")]
    findings = spark.createDataFrame(rows, "finding_id string, doc_id bigint, finding_type string, severity string, confidence double, title string, metadata string")
    evidence = spark.createDataFrame([("f1",), ("f8",), ("f8",)], "finding_id string")
    r = {x.doc_id: x for x in fusion.fuse(findings, evidence).collect()}
    assert r[1].exact_overlap == 0.9 and r[1].source_matches == 2 and r[1].human_review and not r[2].human_review and r[2].style_deviation == 0.4 and r[2].citation_issues == 2 and r[2].ai_writing_signal == "HIGH" and r[2].collusion_clusters == 2 and r[1].ai_writing_signal == "INCONCLUSIVE"
    assert "Human review: true" in fusion.summary(fusion.fuse(findings, evidence)).filter("doc_id = 1").first().summary
    assert '"doc_id":1' in fusion.as_json(fusion.fuse(findings, evidence)).filter("doc_id = 1").first().report


def test_detectors_run_and_one_failure_is_contained(spark):
    copied = "The weighted survey confirms the regional trend in the northern districts during the whole season. Nobody measured the hidden sample before the last revision of the plan."
    sub = spark.createDataFrame([(1, copied + " Another thought ends this text here.", "au", "en"), (2, None, None, None)], "doc_id bigint, text string, author_key string, lang string")
    src = spark.createDataFrame([(11, copied, "au", "en"), (12, "Quite different words stand here in this other source text.", "au", "fr")], "doc_id bigint, text string, author_key string, lang string")
    de.register("broken")(lambda inputs: 1 / 0)
    try:
        findings, runs = de.run_all(de.Inputs(sub, src, src, src, src))
    finally:
        de.REGISTRY.pop("broken")
    status = {r["detector"]: r["status"] for r in runs}
    assert status["broken"] == "failed" and status["exact_copy"] == "ok" and status["web_match"] == "skipped"
    kinds = {(r.finding_type, r.source_id) for r in findings.collect()}
    assert ("exact_copy", 11) in kinds and ("self_plagiarism", 11) in kinds and ("exact_copy", 12) not in kinds


@pytest.mark.parametrize("rows", [20_480, 40])
def test_clusters_need_no_row_for_each_pair(spark, rows):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(6, 12))[rng.integers(0, 6, 200)] + rng.normal(size=(200, 12)) * rng.uniform(0.1, 1.0, (200, 1))
    v[:60] = v[0]  # a class of equal texts has a pair for each two
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (None, v[0].tolist())], "vec_id bigint, embedding array<float>")
    got, want = si.clusters_above(df, 0.8, 5, rows_per_tile=rows).collect(), si.pairs_above(df, 0.8).collect()
    assert sum(r.matches for r in got if r.link) == len(want)
    components = lambda rs: {r.node: r.component for r in graph.connected_components(spark.createDataFrame([(r.a, r.b) for r in rs], "a bigint, b bigint")).collect()}
    part = components(want)
    assert components([r for r in got if r.link]) == part
    best = lambda rs: {c: sorted((-round(r.score, 12), str(r.a), str(r.b)) for r in rs if part[r.a] == c)[:5] for c in set(part.values())}
    assert best([r for r in got if not r.link]) == best(want)
    if rows > 200:
        assert len(got) < len(want) / 3


def test_batch_counts_all_pairs_of_a_cluster(spark, monkeypatch):
    text = "The weighted survey confirms the regional trend in the northern districts."
    docs = spark.createDataFrame([(i, text if i < 7 else text + f" Number {i}." if i < 9 else f"{i} quite other words {i}") for i in range(10)], "doc_id bigint, text string")
    monkeypatch.setattr(si, "pairs_above", None)
    found = de.REGISTRY["batch"](de.Inputs(docs, classroom=docs)).collect()
    assert [(r.doc_id, r.severity, r.confidence, len(r.evidence)) for r in found] == [(0, "high", 0.9, 10)] and '[0,1,2,3,4,5,6,7,8]' in found[0].metadata
    assert [(e.submitted, e.source) for e in found[0].evidence] == sorted((str(a), str(b)) for a in range(7) for b in range(a + 1, 7))[:10]


def test_hashed_vectors_add_in_order(spark):
    from foliomark.operators.encoder import hashed_vectors

    lines = ["The weighted (survey) confirms the trend, the TREND.", "", " . ", "x" * 90 + " survey"]
    import xxhash

    want = np.zeros((4, 384), np.float32)
    for row, line in enumerate(lines):
        for word in line.lower().split():
            word = word.strip(".,;:!?()")
            for part, weight in [(word, 1.0), *((f"#{word}#"[i : i + 3], 0.3) for i in range(len(word)))]:
                h = xxhash.xxh32_intdigest(part)
                want[row, h % 384] += weight if h & 0x80000000 else -weight
    norms = np.linalg.norm(want, axis=1, keepdims=True)
    assert (hashed_vectors(lines) == want / np.where(norms == 0, 1, norms)).all()


def test_simhash_pairs_are_exact(spark):
    random.seed(4)
    base = [random.getrandbits(63) for _ in range(20)]
    rows = [(i, h) for i, h in enumerate(base)] + [(100 + i, h ^ sum(1 << b for b in random.sample(range(63), k))) for i, (h, k) in enumerate(zip(base, range(20)))] + [(999, base[0])]
    got = {(r.a, r.b, r.distance) for r in si.simhash_pairs(spark.createDataFrame(rows, "doc_id bigint, simhash bigint")).collect()}
    least = {}
    for i, h in sorted(rows):
        least.setdefault(h, i)
    want = {(min(i, j), max(i, j), (g ^ h).bit_count()) for g, i in least.items() for h, j in least.items() if i < j and (g ^ h).bit_count() <= 9}
    assert got == want


def test_simhash_pairs_join_no_table_of_keys(spark):
    random.seed(5)
    base = [random.getrandbits(64) - 2**63 for _ in range(40)]
    near = [h ^ sum(1 << b for b in random.sample(range(63), k)) for k in range(4, 14) for h in base[:4]]
    far = [5, -6]  # differ in every bit but one
    hashes = [*base, *near, *far, base[3]]
    df = spark.createDataFrame(list(enumerate(hashes)), "doc_id bigint, simhash bigint")
    least = {h: i for i, h in reversed(list(enumerate(hashes)))}
    for most, rows in ((9, 1 << 17), (9, 7), (3, 7), (64, 7)):
        pairs = si.simhash_pairs(df, most, rows_per_tile=rows)
        assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
        apart = {(min(i, j), max(i, j)): ((g ^ h) & (2**64 - 1)).bit_count() for g, i in least.items() for h, j in least.items() if i != j}
        assert sorted((r.a, r.b, r.distance) for r in pairs.collect()) == sorted((a, b, d) for (a, b), d in apart.items() if d <= most)


def test_vector_index(spark, tmp_path):
    from foliomark.operators.vector_store import VectorIndex

    words = "the weighted survey confirms the regional trend in the northern districts"
    docs = spark.createDataFrame([(1, "ignored"), (2, " ".join(["alpha beta gamma"] * 10)), (3, None)], "doc_id bigint, text string")
    par = spark.createDataFrame([(1, 0, words + " again", False), (1, 0, words + " again", False), (1, 1, "too short", False), (1, 2, words + " in a reference", True)], "doc_id bigint, paragraph_index int, text string, is_reference boolean")
    index = VectorIndex(spark, store.Store(spark, str(tmp_path / "s")))
    with pytest.raises(LookupError):
        index.all()
    index.index_documents(docs, par)
    index.index_documents(docs.filter("doc_id = 1"), par)
    assert {(r.doc_id, r.paragraph_index) for r in index.all().collect()} == {(1, 0), (2, -1)}
    best = index.search([words, "beta gamma alpha"], 1).orderBy("query_id").collect()
    assert [r.doc_id for r in best] == [1, 2] and best[0].score > 0.8
    assert index.search([words], 3, doc_id=2).count() == 1 and index.compare(1, 2, -1.0).count() == 1 and index.get(1).count() == 1
    index.clear()


def test_term_variance(spark):
    df = spark.createDataFrame([(1, "machine learning ML " * 3), (2, "machine learning"), (3, None)], "doc_id bigint, text string")
    assert [(r.doc_id, r.term_count, r.short_count) for r in de.term_variance(df).collect()] == [(1, 3, 3)]


def test_shared_sentences_match_brute_force(spark):
    """Equal sentences count, those within classes of copies too; a sentence of all documents makes no pair alone."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "ba de fi go lu ma".split() for b in "lan mer nos pik rat".split()]
    say = lambda: " ".join(rng.choice(words) for _ in range(12)).capitalize() + "."
    header, pool = say(), [say() for _ in range(12)]
    near = lambda s: s[:-1] + " end."
    texts = {}
    for k in range(24):
        own = [header, say(), *rng.sample(pool, rng.randrange(3))]
        own += [near(s) for s in rng.sample(pool, rng.randrange(2))]
        if k % 5 == 0:
            own.append(own[1])
        texts[k] = " ".join(own)
    texts[24], texts[25], texts[26] = texts[3], texts[3], header
    texts[27], texts[28], texts[29] = pool[0] + " " + pool[0], pool[0] + " " + say(), None
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    sentences = [(k, t.split(". ")) for k, t in texts.items() if t]
    sets = {k: [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (s.strip(".").lower().split() for s in found)] for k, found in sentences}
    want = {}
    for a in sets:
        for b in sets:
            if a < b:
                scores = [j for x in sets[a] for y in sets[b] if (j := len(x & y) / len(x | y)) >= 0.8]
                if len(scores) >= 2:
                    want[a, b] = (len(scores), pytest.approx(sum(scores) / len(scores)))
    copies = {24: 3, 25: 3}
    got = {(r.a, r.b): (r.shared, r.similarity) for r in de.shared_sentences(df).collect()}
    assert got == {p: v for p, v in want.items() if not copies.keys() & set(p) or p in ((3, 24), (3, 25))}
    assert de.shared_sentences(df.limit(0)).count() == 0


def test_collusion_finds_identical_sentences(spark):
    same = "The measured interval of the northern sample narrows over the decade. Every rater of the second panel agreed on the outcome of it. The cost of the whole survey stays constant in the region."
    df = spark.createDataFrame([(1, same, "a", "en"), (2, same, "b", "en"), (3, "Nothing of this is in any of the other texts of the class here.", "c", "en")], "doc_id bigint, text string, author_key string, lang string")
    found = de.REGISTRY["collusion"](de.Inputs(df, classroom=df)).collect()
    assert [r.doc_id for r in found] == [1] and found[0].metadata == '{"clusters":[[1,2]]}'


def test_nearest_in_groups_match_brute_force(spark):
    rng = np.random.default_rng(8)
    vector = lambda: [float(x) for x in rng.normal(size=4)]
    asked = [(k, "hot" if k % 3 else f"g{k % 4}", vector()) for k in range(60)] + [(90, None, vector()), (91, "hot", None), (92, "alone", vector())]
    there = [(100 + k, "hot" if k % 2 else f"g{k % 4}", k % 5, vector()) for k in range(70)] + [(300, "hot", 1, None), (301, None, 1, vector())]
    q = spark.createDataFrame(asked, "vec_id bigint, g string, embedding array<float>")
    v = spark.createDataFrame(there, "vec_id bigint, g string, d int, embedding array<float>")
    want = {}
    for i, g, x in asked:
        for j, h, d, y in there:
            if g and g == h and x and y and (s := float(np.float32(x).astype(float) @ np.float32(y).astype(float))) >= 0.5 and s > want.get((i, d), (0, 0.0))[1]:
                want[i, d] = (j, s)
    label = {j: d for j, _, d, _ in there}
    for rows in (7, 1000):
        got = {(r.query_id, label[r.id]): (r.id, pytest.approx(r.score)) for r in si.nearest_in_groups(q, v, "g", "d", 0.5, block_rows=rows).collect()}
        assert want == got
    assert si.nearest_in_groups(q.limit(0), v, "g", "d", 0.5).count() == 0


def test_exact_copy_and_own_earlier_work(spark):
    run = "every rater of the second panel agreed on the measured interval of the northern sample"
    old = f"First of all {run} in the end. The cost of the whole survey stays constant in the region over time."
    new = f"As before {run} again. The cost of the whole survey stays constant in the region over all time. Something new comes last in this text of ours."
    columns = "doc_id bigint, text string, author_key string, lang string"
    mine = spark.createDataFrame([(7, new, "a", "en"), (8, None, "a", "en"), (9, "Short.", None, "en")], columns)
    past = spark.createDataFrame([(7, old, "a", "en"), (21, old, "a", "en"), (22, old, "b", "en")], columns)
    copied = {(r.source_id, r.title): r for r in de.REGISTRY["exact_copy"](de.Inputs(mine, sources=past)).collect()}
    assert {k[0] for k in copied} == {7, 21, 22} and len(copied) == 6  # a source may have the number of a document
    runs = copied[21, "Passages copied word for word"]
    assert runs.confidence == pytest.approx(0.7 + 0.03 * 2) and runs.severity == "high" and runs.evidence[0].similarity == 1.0 and run in runs.evidence[0].submitted and '"jaccard"' in runs.metadata
    assert copied[22, "Sentences nearly equal to a source"].confidence <= 0.95
    own = de.REGISTRY["self_plagiarism"](de.Inputs(mine, history=past)).collect()
    assert [(r.doc_id, r.source_id) for r in own] == [(7, 21)]  # neither another author's nor the document itself
    assert own[0].severity == "high" and {e.method for e in own[0].evidence} == {"exact_self_copy", "self_plagiarism"} and own[0].evidence[0].similarity == 1.0


def test_own_earlier_work_is_settled_in_tiles(spark, monkeypatch):
    random.seed(8)
    sentence = lambda n: " ".join(random.choice(WORDS) for _ in range(n)).capitalize() + "."
    pool = [sentence(12) for _ in range(30)]
    big = 2**38  # ids that a double would hold, times 2^24 for their sentences not
    rows = [(big + i, " ".join(random.sample(pool, 4)) + " " + sentence(9), "ab"[i % 7 == 0], "en") for i in range(40)]
    columns = "doc_id bigint, text string, author_key string, lang string"
    mine = spark.createDataFrame([*rows[:20], (5, None, "a", "en"), (6, "x", "nobody", "en"), (7, pool[0], None, "en")], columns)
    past = spark.createDataFrame([*rows[18:], (8, None, "a", "en"), (9, pool[0], None, "en")], columns)
    pairs = si.pair_scores(mine.select("doc_id", "author_key").join(past.select(F.col("doc_id").alias("source_id"), "author_key"), "author_key"), mine, past.select(F.col("doc_id").alias("source_id"), "text"), "doc_id", "source_id")
    want = {(r.doc_id, r.source_id): [round(r[n], 4) for n in ("minhash", "simhash", "jaccard", "tfidf", "overall")] for r in pairs.collect()}
    monkeypatch.setattr(de, "pair_scores", None)  # which sends the terms of both texts to every pair
    import json

    found = de.REGISTRY["self_plagiarism"](de.Inputs(mine, history=past, options={"self_plagiarism_min": 0.4})).collect()
    author = {r[0]: r[2] for r in rows}
    assert len(found) > 100 and len({(r.doc_id, r.source_id) for r in found}) == len(found)
    for r in found:
        assert r.doc_id != r.source_id and author[r.doc_id] == author[r.source_id]
        assert list(json.loads(r.metadata)["scores"].values()) == pytest.approx(want[r.doc_id, r.source_id], abs=1.1e-4)
        alike = [e for e in r.evidence if e.method == "self_plagiarism"]
        text = {x[0]: x[1] for x in rows}
        places = [text[r.doc_id].find(e.submitted) for e in alike]
        assert len(alike) <= 5 and places == sorted(places) and min(places, default=0) >= 0 and all(e.source in text[r.source_id] for e in alike)
    # a shared sentence of another's own text is found whatever tile it is in
    shared = {(a[0], b[0]) for a in rows[:20] for b in rows[18:] if a[0] != b[0] and a[2] == b[2] and any(x in a[1] and x in b[1] for x in pool)}
    assert shared <= {(r.doc_id, r.source_id) for r in found}


def test_store_appends_without_rewriting_and_never_lacks_a_pointer(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    rows = lambda *ks: spark.createDataFrame([(k, 1) for k in ks], "k string, v int")
    s.write("t", rows("a"))
    first = s._known("t")["parts"]
    s.append("t", rows("b"))
    s.append("t", rows("c"))
    assert s._known("t")["parts"][0] == first[0] and len(s._known("t")["parts"]) == 3
    reader = s.read("t")
    s.merge("t", rows("c", "d"), ["k"], [F.desc("v")])
    assert reader.count() == 3 and sorted(r.k for r in s.read("t").collect()) == ["a", "b", "c", "d"]
    s.write("t", rows("z"))
    kept = [p.name for p in (tmp_path / "store" / "t").iterdir() if p.name.startswith("p-")]
    assert len(kept) == 2 and not [p for p in (tmp_path / "store" / "t").iterdir() if p.name.startswith("_next")]
    s.MOST_PARTS = 2
    for k in "xyw":
        s.append("t", rows(k))
    assert len(s._known("t")["parts"]) <= 2 and s.read("t").count() == 4


def test_containment_within_groups(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e g", "y"), (3, "a b c d e h", None)], "doc_id bigint, text string, author string")
    other = df.withColumnRenamed("doc_id", "source_id")
    assert {(r.doc_id, r.source_id) for r in si.containment_join(df, other, 5, "doc_id", "source_id", within="author").collect()} == {(1, 1), (2, 2)}
    assert si.containment_join(df, other, 5, "doc_id", "source_id").count() == 9
    assert {(r.doc_id, r.source_id, r.length) for r in si.token_runs(df, other, 5, "doc_id", "source_id", within="author").collect()} == {(1, 1, 6), (2, 2, 6)}


def test_pair_scores_equal_overlap_scores(spark):
    rows = [(i, t) for i, t in texts(9) if t is not None]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    other = df.withColumnRenamed("doc_id", "source_id")
    both = df.withColumnRenamed("text", "a").join(other.withColumnRenamed("text", "b").filter("source_id % 4 = 0"))
    want = {r.k: r for r in si.overlap_scores(both.withColumn("k", F.format_string("%d/%d", "doc_id", "source_id")), "k", "a", "b").collect()}
    got = {f"{r.doc_id}/{r.source_id}": r for r in si.pair_scores(both, df, other, "doc_id", "source_id").collect()}
    assert want.keys() == got.keys() and len(got) > 40
    for k, r in got.items():
        assert [getattr(r, n) for n in ("minhash", "simhash", "tfidf", "jaccard", "overall")] == pytest.approx([getattr(want[k], n) for n in ("minhash", "simhash", "tfidf", "jaccard", "overall")])
