"""The operators for training data against brute force, exact round trips and held-out accuracy, with odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomark.llm import language, mixing, neardup, packing, pieces, repetition, scans, sentences, spans, textform, tokens
from foliomark.llm.furniture import FURNITURE, classify
from foliomark.llm.words import words

DOCS = "doc_id bigint, text string, source string, lang string, id string, n int"


def documents(spark, texts, start=1):
    """Rows with columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(start + i, t, ["a", "b", None][i % 3], "en", "x", 1) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \n\n ", "x", "a" * 20000, "one two three", "​‍", "日本語。", "🙂 🙂"]
VOCAB = [f"{a}{b}" for a in "ba de fi go lu ma ne po ri su ta ve".split() for b in "lan mer nos pik rat sol ton vig".split()]


@pytest.fixture(scope="module")
def model():
    return textform.Model(["The quick brown fox jumps over the lazy dog and uses measure", "Значение выросло после реформы, условие объясняет наблюдение"])


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


# --- problem 1


def page(rng):
    body = [rng.choice(VOCAB) for _ in range(240)]
    lines, line = [], ""
    for w in body:
        if len(line) + len(w) + 1 > 60:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}" if line else w
    lines.append(line + ".")
    return lines


def test_scans_find_and_repair(spark, model):
    rng = random.Random(1)
    clean = [prose(rng, 150) + "." for _ in range(60)]
    lines = page(rng)
    truth = " ".join(lines)
    dirty, expected = [], set()
    for i, line in enumerate(lines):
        no = len(dirty)
        if i == 3:
            word = next(w for w in line.split() if "n" in w)
            line = line.replace(word, word.replace("n", "ri", 1), 1)
            expected.add((no, "misread"))
        if i == 5:
            line = "| " + line
            expected.add((no, "misread"))
        if i == 7:
            dirty.append(line + " " + lines[8].split()[0][:3] + "-")
            expected.add((no, "hyphen"))
            lines[8] = lines[8].split()[0][3:] + lines[8][len(lines[8].split()[0]) :]
            continue
        if i == 10:
            dirty += ["- 12 -", "Rivert et al."]
            expected |= {(no, "furniture"), (no + 1, "furniture")}
        dirty.append(line)
    text = "Title Of This Paper\n\n" + "\n".join(dirty)
    df = documents(spark, [*clean, text, *ODD])
    defects, repaired = scans.repair(df, model)
    got = {(r.line_no - 2, r.defect) for r in defects.collect()}
    assert got == expected
    parts = [r.text for r in repaired.orderBy("paragraph_index").collect()]
    assert parts[0] == "Title Of This Paper" and " ".join(parts[1:]) == truth
    assert scans.repair(df.limit(0), model)[0].count() == 0


def test_without_vectors_misread_words_are_lost(spark, model, monkeypatch):
    """Two topics, each with its own words: a misread word is linked as its neighbours predict, by no spelling alone."""
    rng = random.Random(21)
    topics = [[w for w in VOCAB if w[0] in "bdfgl"], [w for w in VOCAB if w[0] in "mprstv"]]
    clean = [" ".join(rng.choice(topics[k % 2]) for _ in range(150)) + "." for k in range(120)]
    topics[0][0], topics[1][0] = "lanterhip", "lanterlip"  # glyphs apart: h and li
    clean += [" ".join(rng.choice([topics[k % 2][0], *topics[k % 2][1:6]]) for _ in range(120)) + "." for k in range(60)]
    lines = [" ".join(rng.choice(topics[0][1:6]) for _ in range(9)) for _ in range(14)]
    lines[6] = lines[6].replace(lines[6].split()[4], "lanterbip", 1)  # b is read for h
    df = documents(spark, [*clean, "A Title\n\n" + "\n".join(lines)])
    defects, repaired = scans.repair(df, model)
    assert {(r.line_no, r.defect) for r in defects.collect()} == {(8, "misread")}
    assert any("lanterhip" in r.text for r in repaired.collect())
    learnt = scans.vectors
    monkeypatch.setattr(scans, "vectors", lambda surveyed: tuple(np.zeros_like(x) for x in learnt(surveyed)))
    assert scans.repair(df, model)[0].count() == 0


def test_context_chooses_between_readings():
    rng = np.random.default_rng(2)
    words_ = [[f"left{k}" for k in range(12)] + ["hat"], [f"right{k}" for k in range(12)] + ["bat"]]
    v, u = scans.start()
    for epoch in range(6):
        scans.train([np.array([scans.row_of(w) for w in rng.choice(words_[k % 2], 60)]) for k in range(600)], epoch, v, u, rate=0.03, sub=1.0)
    counts = np.zeros(scans.ROWS, np.float32)
    counts[[scans.row_of(w) for side in words_ for w in side]] = 100
    reader, fixes = scans.Reader(v, u, counts), [("hat", 500, 1), ("bat", 500, 1)]
    assert reader.correct("6at", ["left1", "left5"], 0, fixes) == "hat" and reader.correct("6at", ["right1", "right5"], 0, fixes) == "bat"
    assert scans.Reader(v * 0, u * 0, counts).correct("6at", ["left1", "left5"], 0, fixes) is None


def test_vectors_are_merged_in_a_tree(spark):
    rng = np.random.default_rng(3)
    rows, tables = [], rng.random((9, scans.ROWS, 2 * scans.WIDTH + 1)).astype(np.float32)
    for task, table in enumerate(tables):
        rows += [("part", None, part, task, bytearray(scans._weighted(x, task + 1))) for part, x in enumerate(table.reshape(scans.PARTS, -1))]
    v, u, counts = scans.vectors(spark.createDataFrame(rows, "kind string, word string, a bigint, b bigint, payload binary"), fan=2)
    weights = np.arange(1, 10, dtype=np.float32)
    mean = (tables * weights[:, None, None]).sum(axis=0) / weights.sum()
    assert np.allclose(v, mean[:, : scans.WIDTH], atol=1e-4) and np.allclose(u, mean[:, scans.WIDTH : -1], atol=1e-4) and np.allclose(counts, tables[:, :, -1].sum(axis=0), atol=1e-3)


def test_skip_gram_neighbours():
    rng = np.random.default_rng(1)
    left, right = np.arange(10, 20), np.arange(30, 40)
    runs = [rng.choice(left if k % 2 else right, 60) for k in range(600)]
    v, u = scans.start()
    for epoch in range(4):
        scans.train(runs, epoch, v, u)
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert (n[left] @ n[left].T).mean() > (n[left] @ n[right].T).mean() + 0.5


def test_furniture_only_in_wrapped_texts():
    assert FURNITURE not in classify("12\n\nSome text that stands alone.\n\n- 3 -")[1]


# --- problem 2


def brute_groups(rows, similarity, model):
    sets = {}
    for k, t in rows:
        w = words(textform.normalize(t, model))
        sets[k] = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)}, tuple(w) if len(w) >= 5 else textform.normalize(t, model))
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b:
                (x, p), (y, q) = sets[a], sets[b]
                if p == q or x and y and len(x & y) >= similarity * len(x | y):
                    ra, rb = sorted((root(a), root(b)))
                    parent[rb] = ra
    return {k: root(k) for k in sets}


@pytest.mark.parametrize("similarity,hot", [(0.5, 2048), (0.8, 2048), (0.5, 8)])
def test_near_duplicates_match_brute_force(spark, model, similarity, hot):
    rng = random.Random(7)
    texts = []
    for g in range(6):
        base = prose(rng, 120).split()
        for k in range(6):
            t = list(base)
            for _ in range(k * 2):
                t[rng.randrange(len(t))] = rng.choice(VOCAB)
            texts.append(" ".join(t))
    texts += [texts[0], texts[0].upper(), prose(rng, 120), prose(rng, 3), "one two three"]
    texts += ODD
    df = documents(spark, texts)
    groups, links = neardup.near_duplicates(df, similarity, model, hot=hot)
    want = brute_groups([(i + 1, t) for i, t in enumerate(texts) if t is not None], similarity, model)
    assert {r.doc_id: r.group_id for r in groups.collect()} == want
    assert all(r.similarity >= similarity for r in links.collect())
    assert neardup.near_duplicates(df.limit(0), similarity, model)[0].count() == 0


def test_tiles_skip_by_population_count():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2**63, (300, 4), dtype=np.uint64)
    bits[1::2] = bits[::2]
    sizes = rng.integers(50, 500, 300)
    sizes[1::2] = sizes[::2]
    got = set(neardup.compare(np.arange(300), sizes, bits, 0.5, tile=16))
    assert {(i, i + 1) for i in range(0, 300, 2)} <= got
    whole = set(neardup.compare(np.arange(300), sizes, bits, 0.5, tile=1000))
    assert got == whole


@pytest.mark.parametrize("hot", [2048, 4])
def test_every_link_of_a_family(spark, model, hot):
    rng = random.Random(17)
    base = prose(rng, 150).split()
    texts = []
    for k in range(9):
        t = list(base)
        t[k * 15] = "changed"
        texts.append(" ".join(t))
    texts += [texts[0].upper(), prose(rng, 120)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.lower().split() for t in texts[:9])]
    want = {(a + 1, b + 1): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(9) for b in range(a + 1, 9)}
    assert min(want.values()) > 0.85  # nearer than what a spanning tree would join
    df = documents(spark, texts)
    groups, links = neardup.near_duplicates(df, 0.5, model, hot=hot)
    assert {(r.a, r.b): round(r.similarity, 9) for r in links.collect()} == {k: round(v, 9) for k, v in want.items()} and links.count() == 36
    assert {r.doc_id: r.n_links for r in groups.collect()} == {**{i: 8 for i in range(1, 11)}, 11: 0}
    only, joined = neardup.near_duplicates(df, 0.5, model, hot=hot, tree=True)
    assert {tuple(r) for r in only.collect()} == {tuple(r)[:3] for r in groups.collect()} and joined.count() >= 8


# --- problem 3


def brute_spans(docs, sources, span):
    known = {t[i : i + span] for t in sources for i in range(len(t) - span + 1)}

    def merge(starts):
        out = []
        for s in starts:
            if out and s <= out[-1][1]:
                out[-1][1] = s + span
            else:
                out.append([s, s + span])
        return out

    result, free, owners = set(), {}, {}
    for k, t in docs:
        own = merge([i for i in range(len(t) - span + 1) if t[i : i + span] in known])
        result |= {("source", k, a, b) for a, b in own}
        free[k] = [i for i in range(len(t) - span + 1) if not any(i < b and a < i + span for a, b in own)]
        for i in free[k]:
            owners.setdefault(t[i : i + span], set()).add(k)
    for k, t in docs:
        result |= {("document", k, a, b) for a, b in merge([i for i in free[k] if len(owners[t[i : i + span]]) > 1])}
    return result


@pytest.mark.parametrize("hot, broadcast_chars", [(200_000, 5_000_000), (2, 5_000_000), (200_000, 0)])
def test_shared_spans_match_brute_force(spark, hot, broadcast_chars):
    rng = random.Random(3)
    source = prose(rng, 80)
    shared = [prose(rng, 40) for _ in range(3)]
    texts = []
    for k in range(14):
        parts = [prose(rng, 30), shared[k % 3][rng.randrange(20) :], prose(rng, 10)]
        if k % 4 == 0:
            parts.insert(1, source[30 : 30 + 60 * (k % 5 + 1)])
        texts.append(" ".join(parts))
    again = prose(rng, 30)
    texts += [texts[2], texts[5][:170], "ab" * 300, *ODD, again + " x " + again, prose(rng, 9) + again]
    df = documents(spark, texts).repartition(7, "doc_id")
    src = spark.createDataFrame([(source,), (None,), ("short",)], "text string")
    got = {tuple(r) for r in spans.shared_with_documents(df, src, 60, hot=hot, broadcast_chars=broadcast_chars).collect()}
    assert got == brute_spans([(i + 1, t) for i, t in enumerate(texts) if t is not None], [source], 60)
    assert spans.shared_with_documents(df.limit(0), src, 60).count() == 0
    share = spans.shared_share(df, spans.shared_with_documents(df, src, 60)).filter("doc_id = 17").first()
    assert share.shared_share == pytest.approx(1.0) or share.shared_chars <= share.n_chars


@pytest.mark.parametrize("texts", [400, 2400])
def test_sketch_keeps_repeated_anchors_and_few_others_at_any_size(spark, texts):
    """Of anchors that one text has at most one in 20 passes; of repeated ones, hot ones too, none is lost."""
    random_ = np.random.default_rng(texts)
    hot = random_.integers(0, 2**63, 3, dtype=np.uint64)
    rows, single, twice = [], 0, {int(x) for x in hot.view(np.int64)}
    pair = random_.integers(0, 2**63, 40, dtype=np.uint64)
    twice |= {int(x) for x in pair.view(np.int64)}
    for k in range(texts):
        own = random_.integers(0, 2**63, 500, dtype=np.uint64)
        single += len(own)
        h = np.concatenate([own, hot, pair if k in (0, texts - 1) else hot[:0]])
        rows.append((k, bytearray(h.tobytes())))
    df = spark.createDataFrame(rows, "same bigint, anchors binary").repartition(4)
    total = single + 3 * texts + 80
    kept = spans._estimated_repeated(df, max(1, -(-16 * total // spans.CELLS))).groupBy("anchor").agg(F.count("*").alias("n")).collect()
    counts = {r["anchor"]: r["n"] for r in kept}
    assert all(counts[int(x)] == texts for x in hot.view(np.int64)) and all(counts[int(x)] == 2 for x in pair.view(np.int64))
    assert len(counts.keys() - twice) <= 0.05 * single


def test_shared_in_evidence(spark):
    rng = random.Random(4)
    a = prose(rng, 40)
    rows = [(1, a, "zz " + a[:170] + " yy"), (2, None, a), (3, a, None), (4, a[:100], a), (5, a, a)]
    df = spark.createDataFrame(rows, "evidence_id bigint, submitted_text string, source_text string")
    assert {tuple(r) for r in spans.shared_in_evidence(df).collect()} == {("evidence", 1, 0, 170), ("evidence", 5, 0, len(a))}


# --- problem 4

CASES = {
    "Dr. Lee came. He saw Fig. 2. The end": ["Dr. Lee came.", "He saw Fig. 2.", "The end"],
    "See e.g. the map. pH readings of 5.2 rise.": ["See e.g. the map.", "pH readings of 5.2 rise."],
    "She asks: “Why? Nobody knows.” and then goes on. “A quote stands alone.” Next one.": ["She asks: “Why? Nobody knows.” and then goes on.", "“A quote stands alone.”", "Next one."],
    "Am 3. März 2016 war es z. B. kalt usw. Die Messung (vgl. S. 9) half.": ["Am 3. März 2016 war es z. B. kalt usw.", "Die Messung (vgl. S. 9) half."],
    "Quelle surprise ! M. X écrit : « c’est tout. Cela suffit. » puis renvoie à la fig. 3.": ["Quelle surprise !", "M. X écrit : « c’est tout. Cela suffit. » puis renvoie à la fig. 3."],
    "他写道：“这是。够了。”然后又谈到。真的吗？“独立。”好！": ["他写道：“这是。够了。”然后又谈到。", "真的吗？", "“独立。”", "好！"],
    "В 2010 г. он пришёл, т. е. рано. А. П. Смит пишет и т. д. Конец.": ["В 2010 г. он пришёл, т. е. рано.", "А. П. Смит пишет и т. д.", "Конец."],
    "यह ठीक है। डॉ. राम आए? हाँ।": ["यह ठीक है।", "डॉ. राम आए?", "हाँ।"],
    "هل جاء؟ يرى د. علي ذلك. نعم.": ["هل جاء؟", "يرى د. علي ذلك.", "نعم."],
    "The model... if needed. It rose; then fell: so, well.": ["The model... if needed.", "It rose; then fell: so, well."],
    "Heading only": ["Heading only"],
    "[1] Smith, A. (2010). One title. Annals of X Studies, 3(1), 1-2.": ["[1] Smith, A. (2010). One title. Annals of X Studies, 3(1), 1-2."],
}


@pytest.mark.parametrize("text", CASES)
def test_sentences(text):
    got, before = [], 0
    for e in sentences.units(text):
        got.append(text[before:e].strip())
        before = e
    assert got == CASES[text]


def test_thai_rules_by_the_whole_block():
    thai, latin = "การวิจัยนี้ศึกษาผลของสภาพอากาศต่อผลผลิตข้าว " * 12, "a quotation in another script " * 15
    alone, opened = sentences.sentence_ends(thai), sentences.sentence_ends(latin + thai)
    assert len(alone) > 1 and [e - len(latin) for e in opened][-len(alone) :] == alone


def test_sentences_across_furniture():
    text = "A Long Title Of The Paper\n\n" + "\n".join(["the weighted survey confirms the regional trend in the north", "and the interval of the sample narrows over the whole decade", "- 7 -", "", "while the cost stays constant. Here the second sentence begins", "and it ends on this line of the page after some more words.", "Name   12   4.5", "Other   3   9.1"])
    got, before = [], 0
    for e in sentences.units(text):
        got.append(text[before:e].strip())
        before = e
    assert len(got) == 5 and got[1].endswith("constant.") and got[3] == "Name   12   4.5"


@pytest.mark.parametrize("text", ["Բարեւ աշխարհ։ Ինչպես ես։", "ሰላም ነው። እንዴት ነህ።", "សួស្តី។ អ្នកសុខសប្បាយ។", "မင်္ဂလာပါ။ နေကောင်းလား။", "བཀྲ་ཤིས། བདེ་ལེགས།", "Really‼ He said so.", "So what⁇ Nothing.", "他来了。她走了。", "وصل اليوم؟ نعم۔", "वह आया। वह गया॥"])
def test_terminators_of_all_scripts(text):
    assert len(sentences.units(text)) == 2


def test_no_other_mark_ends_a_sentence():
    marks = "\\/^-_|~#*+=<>@$%&`\"'()[]{}:;,"
    assert not set(marks) & set(sentences.TERMINATORS) and all(not sentences._TERM.match(c) and not sentences._BASIC_TERM.match(c) for c in marks)
    text = "The folder C:\\Temp\\New is here. So it is."
    assert sentences.units(text) == [text.index(".") + 1, len(text)]


@pytest.mark.parametrize("text, n", [("He said no. Then he left.", 2), ("I studied art. Then I left.", 2), ("She reached the cap. Then she stopped.", 2), ("He ate a fig. Then he left.", 2), ("See No. 5 and Fig. 3 in vol. II of the set.", 1), ("El art. 5 de la ley y el cap. IV de la norma dicen eso. Es así.", 2), ("Dr. Smith met Prof. Lee. They spoke.", 2), ("Das gilt vgl. Abb. 3 und z.B. Berlin.", 1), ("Il sig. Rossi non è qui per la riunione di oggi. Torna domani.", 2), ("The sig. Rossi noted it in the book and that was it.", 2)])
def test_abbreviations_follow_the_language(text, n):
    assert len(sentences.units(text)) == n


def test_sentence_units_frame(spark):
    df = documents(spark, [*ODD, "One. Two."])
    rows = sentences.sentence_units(df).collect()
    assert {r.doc_id for r in rows} == {4, 5, 6, 8, 9, 10} and [r.sentence_end for r in rows if r.doc_id == 10] == [4, 9]
    assert sentences.sentence_units(df.limit(0)).count() == 0


# --- problem 5


def test_consistent_form(model):
    for dirty, clean in (("ｍｅａｓｕｒｅ", "measure"), ("mе́asure", "méasure"), ("quiсk brоwn fох", "quick brown fox"), ("the dog", "the dog"), ("la​zy", "lazy"), ("ｄоg", "dog"), ("выросло", "выросло"), ("At α = 5 μm", "At α = 5 μm"), ("می‌کند", "می‌کند"), ("", "")):
        assert textform.normalize(dirty, model) == clean


def test_forms(model):
    for text, found in (("ｗｏｒｄ", ["width"]), ("café", ["accent"]), ("wo­rd", ["invisible"]), ("می‌کند", []), ("one, two", ["space"]), ("« mot »", []), ("5 %  !", []), ("the quiсk fox", ["lookalike"]), ("α = 1", []), ("Значение выросло", []), ("plain", []), ("，。", [])):
        assert textform.forms(text, model) == found, text


def test_form_frames(spark, model):
    df = documents(spark, [*ODD, "ｗｏｒｄ"])
    assert [(r.record_id, r.form) for r in textform.found_forms(df, model, "document", "doc_id", "text").collect()] == [(10, "width")]
    rows = {r.doc_id: r.consistent_text for r in textform.consistent(df, model, "doc_id", "text").collect()}
    assert len(rows) == 10 and rows[1] is None and rows[10] == "word"


# --- problem 6

SAMPLES = "/root/testdata/sf0.01/lang_samples.parquet"


def test_language_held_out():
    pd = pytest.importorskip("pandas")
    try:
        s = pd.read_parquet(SAMPLES)
    except FileNotFoundError:
        pytest.skip("no samples")
    train, test = s[s.sample_id % 4 != 0], s[s.sample_id % 4 == 0]
    m = language.Identifier(train.text.tolist(), train.lang.tolist())
    right = sum(m.identify(t)[0] == lang for t, lang in zip(test.text, test.lang))
    assert right >= 0.97 * len(test)
    assert m.identify("") == (None, 0.0) and m.identify("123 !") == (None, 0.0)


def test_labels():
    for label, code in (("EN", "en"), ("en-GB", "en"), ("zh_CN", "zh"), ("German", "de"), ("fra", "fr"), (" ", None), (None, None), ("n/a", "n/a"), ("nl", "nl")):
        assert language.code_of(label) == code


def test_wrong_labels(spark):
    train = [("the cat sits in the house and the dog runs over the hill", "en"), ("die Katze sitzt im Haus und der Hund läuft über den Hügel", "de"), ("кошка сидит в доме и собака бежит", "ru")]
    m = language.Identifier([t for t, _ in train for _ in range(3)], [lang for _, lang in train for _ in range(3)])
    docs = spark.createDataFrame([(1, "en"), (2, "de"), (3, None), (4, "en")], "doc_id bigint, lang string")
    par = spark.createDataFrame([(1, 0, "The dog sits in the house and runs over the hill."), (1, 1, "Die Katze sitzt im Haus und läuft."), (1, 0, "The dog sits in the house and runs over the hill."), (1, 2, "The cat sits in the house and the hill."), (2, 0, "The cat runs over the hill and the house."), (3, 0, "кошка бежит в доме и сидит."), (4, 0, None), (None, 0, "x")], "doc_id bigint, paragraph_index int, text string")
    got = {tuple(r) for r in language.wrong_labels(docs, par, m, least_confidence=0.3).collect()}
    assert got == {(1, 1, "de"), (2, -1, "en"), (3, -1, "ru")}


# --- problem 7


def test_repeated_words_match_exact():
    rng = random.Random(5)
    for n in (0, 3, 6, 40, 200):
        for size in (2, 5, 60):
            t = [rng.choice(VOCAB[:size]) for _ in range(n)]
            assert repetition.repeated_words(t, 6) == repetition.repeated_words_exactly(t, 6)


def test_binomial_bound():
    assert repetition.binomial_upper(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-6)
    assert repetition.binomial_upper(5, 5, 0.05) == 1.0 and 0.1 < repetition.binomial_upper(10, 100, 0.05) < 0.2


def test_latin_names_do_not_make_a_chinese_text_spaced():
    text = "微弱的模型解释了新的趋势。Weisaedraeth Vaqualiask Koutreix " * 3
    assert words("他来了")[0] == "他" and words(text)[:2] == ["微", "弱"] and "w" in words(text) and "weisaedraeth" not in words(text)
    assert "趋" in words("One English text with a word 趋势 in it") and "english" in words("One English text with a word 趋势 in it")


@pytest.mark.parametrize("text, form", [("mo\u0501el of use", "model of use"), ("m\u0585del of use", "model of use"), ("m\u2c9fdel of use", "model of use"), ("Он cop ушёл", "Он сор ушёл"), ("Հայաստան", "Հայաստան")])
def test_lookalikes_of_short_texts_and_further_alphabets(model, text, form):
    assert textform.normalize(text, model) == form


def test_letter_pairs_are_counted_over_all_rows(spark):
    rows = [("алфавит",)] * 3 + [("letters",), (None,)]
    df = spark.createDataFrame(rows, "text string").repartition(3)
    learnt, given = textform.learn(df, df), textform.Model([r[0] for r in rows if r[0]] * 2)
    assert learnt.logs == given.logs and learnt.unseen == given.unseen


def test_the_sample_of_labelled_sentences_holds_every_language(spark):
    langs = ["ar", "de", "en", "fr", "zh", "ur"]
    df = spark.createDataFrame([(lang, f"{lang} text {k}") for lang in langs for k in range(200)], "lang string, text string")
    seen = {}
    original = language.Identifier
    language.Identifier = lambda texts, found: seen.update({lang: found.count(lang) for lang in langs})
    try:
        language.learn(df, 300)
    finally:
        language.Identifier = original
    assert all(25 <= n <= 80 for n in seen.values()) and sum(seen.values()) <= 400


def test_cutoffs_control_false_rejections():
    rng = np.random.default_rng(6)
    rows = [("a", float(s), False) for s in rng.beta(1, 12, 3000)] + [("a", 0.9, True)] * 50 + [("b", 0.1, False)] * 5
    grid = [k / 100 for k in range(1, 101)]
    found = repetition.choose_cutoffs(rows, grid, 0.05, 0.05, ("a", "b"))
    cutoff, failures, good, bound = found["a"]
    assert good == 3000 and bound <= 0.05 and failures <= 150
    lower = cutoff - 0.01
    assert repetition.binomial_upper(sum(s >= lower for t, s, bad in rows if t == "a" and not bad), 3000, 0.025) > 0.05  # no lower one is certain
    assert found["b"][0] is None and found["b"][3] < 1
    # on fresh rows of the same kind the rate holds
    assert (rng.beta(1, 12, 100_000) >= cutoff).mean() <= 0.05


def test_repetitive(spark, model):
    rng = random.Random(8)
    block = prose(rng, 12)
    df = documents(spark, [*ODD, prose(rng, 200), " ".join([block] * 9), prose(rng, 60) + " " + block + " " + block])
    rejected, cutoffs = repetition.repetitive(df, model)
    assert {r.doc_id for r in rejected.filter("certain").collect()} == {11}
    assert {r.stratum for r in cutoffs.collect()} == set(repetition.STRATA)
    assert repetition.repetitive(df.limit(0), model)[0].count() == 0


def test_cutoffs_decide_what_is_rejected(spark, model):
    rng = random.Random(18)
    texts = [prose(rng, 60) for _ in range(400)]
    for k in range(40):
        block = prose(rng, 20)
        texts.append(" ".join([block] * (2 + k % 4)) + " " + prose(rng, 15))
    df = documents(spark, texts)
    rejected, cutoffs = repetition.repetitive(df, model)
    latin = cutoffs.filter("stratum = 'latin'").first()
    assert 0 < latin.cutoff < 0.4 and latin.bound <= 0.02 and latin.acceptable >= 400
    bad = repetition.repetition(df, model).filter("repeated_share >= 0.4").count()
    assert bad >= 20 and rejected.filter("certain").count() == bad
    strict, _ = repetition.repetitive(df, model, cutoffs={"latin": 0.6})
    assert 0 < strict.filter("certain").count() < bad


def test_cutoffs_come_from_all_documents(spark):
    rng = random.Random(28)
    texts = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=30)) for _ in range(2600)]
    block = "one two three four five six seven"
    texts += [f"{block} {block} " + " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=40)) for _ in range(60)]  # high scores, acceptable
    texts += [" ".join([block] * 5)] * 40
    df = documents(spark, texts)
    expected = [("latin", *(f(t.split(), 6) for f in (lambda w, n: repetition.measured(w, n)[0], lambda w, n: repetition.repeated_words_exactly(w, n) >= 0.4 * len(w)))) for t in texts]
    assert sum(bad for _, _, bad in expected) == 40
    chosen = repetition.choose_cutoffs(expected, [k / 100 for k in range(1, 101)], 0.02, 0.05)
    for table in (df, df.union(df)):
        found = {r.stratum: tuple(r)[1:] for r in repetition.repetitive(table)[1].collect()}
        assert found == chosen and found["latin"][2] == 2660


def test_labels_compare_words_where_hashes_collide(monkeypatch):
    tokens_ = prose(random.Random(5), 12).split()
    assert repetition.is_bad(tokens_ * 2, 6, 0.4, len(tokens_)) and not repetition.is_bad([], 6, 0.4, 0)
    monkeypatch.setattr(repetition, "_gram_hashes", lambda words_, run: np.zeros(max(0, len(words_) - run + 1), np.uint64))
    again = repetition.measured(tokens_, 6)[1]
    assert again >= 0.4 * len(tokens_) and not repetition.is_bad(tokens_, 6, 0.4, again)
    assert repetition.is_bad(tokens_ * 2, 6, 0.4, repetition.measured(tokens_ * 2, 6)[1])


def test_binomial_bound_of_many_texts():
    assert repetition.binomial_upper(160_000, 8_000_000, 0.05 / 3) == pytest.approx(0.02 + 2.128 * (0.02 * 0.98 / 8e6) ** 0.5, abs=1e-6)


# --- problems 8, 9, 10


def test_packing(spark):
    rng = random.Random(9)
    texts = [prose(rng, rng.randrange(5, 120)) for _ in range(150)] + [prose(rng, 900), *ODD]
    df = documents(spark, texts)
    packed = packing.pack(df, 256, shard_rows=60).collect()
    load, parts = {}, {}
    for r in packed:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        parts.setdefault(r.doc_id, []).append(r.n_tokens)
    assert max(load.values()) <= 256 and set(parts) == set(range(1, len(texts) + 1))
    for i, t in enumerate(texts):
        size = tokens.count(t)
        assert sum(parts[i + 1]) == size and len(parts[i + 1]) == max(1, -(-size // 256))
    assert sum(load.values()) / (256 * len(load)) > 0.95
    assert packing.pack(df.limit(0), 256).count() == 0


def test_bm25_prefers_related():
    bags = [np.array([1, 2, 3], np.uint32), np.array([1, 2, 4], np.uint32), np.array([7, 8, 9], np.uint32)]
    index = packing.Index(bags, [np.ones(3, np.uint16)] * 3, np.full(3, 3.0))
    assert index.scores(0)[1] > index.scores(0)[2] == 0


def test_neighbours_fill_the_window():
    bags = [np.array(x, np.uint32) for x in ([1, 2, 3], [1, 2, 4], [1, 5, 6], [7, 8, 9], [7, 8, 10])]
    index = packing.Index(bags, [np.ones(3, np.uint16)] * 5, np.full(5, 3.0))
    # the unrelated text would fill the seed's container to the last token, but the neighbours still fit
    assert packing.fill([60, 20, 15, 40, 5], index, 100) == [[0, 1, 2, 4], [3]]


def test_mixing(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, rng.randrange(10, 60)), "a" if i % 10 else "b") for i in range(400)] + [(900, None, "a"), (901, "text", None), (902, "text", "unknown")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 3), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    uses, shares = mixing.mix(df, targets, bucket_rows=50)
    got = {r.source: r for r in shares.collect()}
    assert abs(got["a"].actual_share - 0.7) < 0.02 and abs(got["b"].actual_share - 0.3) < 0.02
    counts = {r.doc_id: r.use_count for r in mixing.use_counts(df, uses).collect()}
    assert max(v for k, v in counts.items() if k < 900 and k % 10) <= 1 and max(counts.values()) <= 3 and counts[900] == counts[901] == counts[902] == 0
    running = [r.running_tokens for r in uses.orderBy("virtual_finish", "running_tokens").collect()]
    assert running == sorted(running)
    assert mixing.mix(df.limit(0), targets)[0].count() == 0


def test_a_repeated_id_keeps_the_links_of_each_of_its_texts(spark, model):
    rng = random.Random(41)
    first, second = prose(rng, 60), prose(rng, 60)
    rows = [(5, first), (5, second), (5, second), (7, first + " end"), (9, second + " end"), (9, None)]
    groups, links = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 0.5, model)
    assert {(r.a, r.b) for r in links.collect()} == {(5, 7), (5, 9)} and links.count() == 2
    assert sorted((r.doc_id, r.class_id, r.group_id, r.n_links) for r in groups.collect()) == [(5, 5, 5, 1)] * 3 + [(7, 7, 5, 1), (9, 9, 5, 1)]


def test_hot_blocks_are_sent_to_parts_that_exist(spark):
    """One block of 600 texts of three sizes, cut at 50: every pair within reach of sizes is compared once."""
    rng = np.random.default_rng(4)
    sizes = np.repeat([40, 100, 900], 200)
    bits = rng.integers(0, 2**63, (600, 4), dtype=np.uint64)
    bits[1::2] = bits[::2]
    bands = np.zeros((600, 2 * neardup.BANDS), np.uint32)
    bands[:, 2:] = rng.integers(0, 2**32, (600, 2 * neardup.BANDS - 2), dtype=np.uint32)
    rows = [(k, int(sizes[k]), bytearray(bands[k].tobytes()), bytearray(bits[k].tobytes())) for k in range(600)]
    found = neardup.candidates(spark.createDataFrame(rows, "rep bigint, n int, bands binary, bits binary"), 0.5, hot=50)
    got = {(r.a, r.b) for r in found.collect()}
    assert {(k, k + 1) for k in range(0, 600, 2)} <= got
    assert got == set(neardup.compare(np.arange(600), sizes, bits, 0.5))


def test_a_source_far_above_its_share_fills_no_bucket(spark, monkeypatch):
    """Equal shares of a source of 40 texts and one of 4,000: no bucket of the second running sum holds much more than its part."""
    rng = random.Random(31)
    rows = [(k, prose(rng, 12), "big" if k % 101 else "small") for k in range(4040)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.5, 1)], "source string, target_share double, max_repeats int")
    largest, running = [], mixing._running

    def watched(df, groups, bucket, order, value, out):
        if bucket == "_time":
            largest.append((df.groupBy(bucket).count().agg(F.max("count")).first()[0], df.count()))
        return running(df, groups, bucket, order, value, out)

    monkeypatch.setattr(mixing, "_running", watched)
    uses, shares = mixing.mix(df, targets, bucket_rows=100)
    got = {r.source: r.actual_share for r in shares.collect()}
    assert abs(got["big"] - 0.5) < 0.05 and abs(got["small"] - 0.5) < 0.05
    (most, total), = largest
    assert total <= 110 and most <= total

    uses, shares = mixing.mix(df, targets, budget=40_000, bucket_rows=100)  # the small source is used up
    most, total = largest[-1]
    assert most <= 400 < total and {r.source: r.most_uses for r in shares.collect()}["small"] == 1


@pytest.mark.parametrize("limit,overlap", [(64, 16), (256, 0), (30, 8)])
def test_pieces(limit, overlap):
    rng = random.Random(11)
    texts = ["\n\n".join(f"Heading {k}\n\n{prose(rng, 90)}. {prose(rng, 40)}." for k in range(6)), "x" * 900, "一二三" * 200, "🙂" * 120, "a b", prose(rng, 700), "", "\n" * 300]
    for t in texts:
        found = pieces.split(t, limit, overlap)
        assert bool(found) == bool(t)
        covered = 0
        for k, (a, b, n, level) in enumerate(found):
            assert tokens.count(t[a:b]) == n <= limit and a <= covered < b and level in pieces.LEVELS
            if k:
                assert tokens.count(t[a:covered]) <= overlap
            covered = b
        assert covered == len(t)


def test_pieces_frame(spark):
    df = documents(spark, [*ODD, "a b " * 400])
    rows = pieces.split_pieces(df, 128, 16, only_oversized=True).collect()
    assert {r.doc_id for r in rows} == {5, 10}
    assert pieces.split_pieces(df.limit(0), 128, 16).count() == 0


def test_token_ends():
    for t in ("plain text", "añ̃o 日本 🙂🙂", "mixed 中文 and é"):
        ends = tokens.token_ends(t)
        assert ends[-1] == len(t) and (np.diff(ends) >= 0).all()
