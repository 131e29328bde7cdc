import random

import pytest

from lexloom.operators import index as module
from lexloom.operators import search
from lexloom.operators.index import Index, index_stream

random.seed(3)
WORDS = ["".join(random.choices("abcdefg", k=random.randint(3, 9))) for _ in range(300)]
OFTEN = [1 / (k + 1) for k in range(300)]
QUERIES = (WORDS[:1], WORDS[200:202], [WORDS[0], WORDS[250], WORDS[120]], ["absent"])


def text():
    return " ".join(random.choices(WORDS, OFTEN, k=random.randint(0, 60)))


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "uid string, text string")


def agrees(spark, index, docs):
    for words in QUERIES:
        want = [tuple(r) for r in search.bm25(frame(spark, docs), "uid", "text", words).collect()]
        found = index.search(words)
        assert found.rows == want and found.blocks_read <= found.blocks


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """An index after upserts, removals, a replay and a merge, with what it should hold."""
    docs = {f"n{i}": text() for i in range(400)} | {"empty": "", "none": None}
    index = Index(spark, str(tmp_path_factory.mktemp("index")), ("text",), parts=4, block_bits=3)
    assert index.search(["abc"]).rows == [] and index.near(["abc"]) == {} and index.segments() == []
    index.upsert(frame(spark, docs))
    agrees(spark, index, docs)
    for k in range(2):
        new = {f"n{random.randint(0, 450)}": text() for _ in range(40)}
        gone = [u for u in random.sample(sorted(docs), 10) if u not in new]
        for _ in range(2):  # a replay changes nothing
            index.upsert(frame(spark, new), spark.createDataFrame([(u,) for u in gone], "uid string"), name=f"b{k}")
        docs |= new
        for u in gone:
            del docs[u]
    return index, docs


def test_rows_equal_a_full_scan_after_upserts(spark, kept):
    index, docs = kept
    assert len(index.segments()) == 3
    agrees(spark, index, docs)


def test_misspelt_words_find_all_near_terms(kept):
    index, docs = kept
    terms = {w for t in docs.values() for w in (t or "").split()}
    for word in (WORDS[5][:2] + "z" + WORDS[5][3:], WORDS[7] + "q", WORDS[9][1:], "zzzzzzzz"):
        want = {t: 1 - distance(word, t) / min(len(word), len(t)) for t in terms if distance(word, t) <= 2 and distance(word, t) < min(len(word), len(t))}
        assert index.near([word]) == pytest.approx(want)


def test_merged_segments_answer_alike(spark, kept):
    index, docs = kept
    index.merge(5)
    assert len(index.segments()) == 3
    index.merge(2)
    assert len(index.segments()) == 1
    agrees(spark, index, docs)
    docs["n1"] = "altogether new"
    index.upsert(frame(spark, {"n1": docs["n1"]}))
    for k in range(2, 5):
        docs[f"n{k}"] = f"new too {WORDS[k]}"
        index.upsert(frame(spark, {f"n{k}": docs[f"n{k}"]}))
    index.merge(4)  # the marks of merged segments about the one that stays are carried over
    assert len(index.segments()) == 2
    agrees(spark, index, docs)


def test_blocks_read_grow_slower_than_the_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "ROUNDS", (4, 16))
    read = []
    for n in (300, 1500):
        docs = {f"n{i}": " ".join(["common"] * random.randint(1, 3) + ["x"] * random.randint(0, 80)) for i in range(n)}
        index = Index(spark, f"{tmp_path}/{n}", ("text",), parts=2, block_bits=3)
        index.upsert(frame(spark, docs))
        found = index.search(["common"])
        assert found.rows == [tuple(r) for r in search.bm25(frame(spark, docs), "uid", "text", ["common"]).collect()]
        read.append((found.blocks, found.blocks_read))
    assert read[1][0] > 4.5 * read[0][0] and read[1][1] - read[0][1] < (read[1][0] - read[0][0]) / 5 and read[1][1] < read[1][0] / 5


def test_a_stream_keeps_it_current(spark, tmp_path):
    index, docs = Index(spark, f"{tmp_path}/index", ("text",), parts=2, block_bits=3), {}
    for k in range(3):
        new = {f"n{i}": text() for i in range(k, 20, k + 1)}
        frame(spark, new).coalesce(1).write.json(f"{tmp_path}/in/{k}")
        docs |= new
        stream = spark.readStream.schema("uid string, text string").json(f"{tmp_path}/in/*")
        index_stream(stream, index, f"{tmp_path}/checkpoint", most=2).awaitTermination()
    assert len(index.segments()) <= 2
    agrees(spark, index, docs)


def shuffled(spark):
    """Bytes that the session's tasks have written for others so far."""
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_neither_texts_nor_postings_are_shuffled(spark, tmp_path):
    docs = {f"n{i}": " ".join(random.choices(WORDS, k=300)) for i in range(400)}
    rows = spark.createDataFrame(list(docs.items()), "uid string, text string").repartition(4)
    rows.write.parquet(f"{tmp_path}/in")
    index, before = Index(spark, f"{tmp_path}/index", ("text",), parts=2), shuffled(spark)
    index.upsert(spark.read.parquet(f"{tmp_path}/in"))
    assert shuffled(spark) - before < sum(map(len, docs.values())) / 5
    agrees(spark, index, docs)


def test_marks_about_merged_segments_count_once(spark, tmp_path):
    """A large segment that stays has marked documents of a small one that is merged."""
    index, docs = Index(spark, f"{tmp_path}/index", ("text",), parts=2, block_bits=3), {}
    for k, n in ((0, 8), (4, 40), (60, 4), (70, 3), (80, 3)):
        new = {f"n{i}": f"{WORDS[0]} {text()}" for i in range(k, k + n)}
        index.upsert(frame(spark, new))
        docs |= new
    index.merge(4)
    assert len(index.segments()) == 2
    agrees(spark, index, docs)


def test_blocks_are_whole_over_several_runs_of_a_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "RUN", 50)
    monkeypatch.setattr(module, "ROWS", 7)
    monkeypatch.setattr(module, "DOCS", 3)
    docs = {f"n{i}": text() for i in range(60)} | {"twice": "one two one"}
    batches = [spark.createDataFrame([(u, t)], "uid string, text string") for u, t in (("twice", "one two"), ("none", None))]
    made = frame(spark, docs).unionByName(batches[0]).unionByName(batches[1]).coalesce(1)
    index = Index(spark, f"{tmp_path}/index", ("text",), parts=2, block_bits=3)
    index.upsert(made)
    agrees(spark, index, docs | {"none": None})
    assert index.near(["oen"]) == pytest.approx({t: 1 - distance("oen", t) / min(3, len(t)) for t in {w for x in docs.values() for w in x.split()} if distance("oen", t) <= 2 and distance("oen", t) < min(3, len(t))})
