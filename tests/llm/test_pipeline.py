"""The pipeline's stages against plain versions, one by one and together."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_ngram_join import brute as brute_groups
from test_pii import brute as brute_spans

import corpus_pipeline as cp
from corpuslens.llm.common import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Further columns named like those that the operators make.
CLASH = ("score", "lang_pred", "base", "spans", "size", "key", "node", "component_id", "epochs", "ids")


def rows():
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 7))) for _ in range(200)]
    out = []
    for i in range(150):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 4, 30, 120]))]
        if i % 5 == 0:
            words.insert(len(words) // 2, rnd.choice(["joe@example.org", "10.1.2.3", "4111111111111111", "+1 (555) 123-4567"]))
        out.append((i, " ".join(words), rnd.choice(["xx", "xx", "yy", None]), rnd.choice(["a", "a", "a", "b", None]), 1))
    for i in range(20):  # copies and near copies of a long one
        words = out[next(k for k in range(150) if len(out[k][1].split()) >= 120)][1].split()
        if i % 2:
            words[rnd.randrange(len(words))] = f"new{i}"
        out.append((200 + i, " ".join(words), "xx", "b", 1))
    out += [(300, None, "xx", "a", None), (301, "", None, "a", 0), (302, "12 34 !!", "yy", None, 8), (303, "word " * 30_000, "xx", "c", 1), (304, "twice the same id here", "xx", "c", 1), (304, "twice the same id here", "xx", "c", 1), (None, "a document without an id", None, None, 1)]
    return out


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Each stage's result, written and reread as the driver does."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3).withColumns({c: F.lit("kept") for c in CLASH})
    out = [docs]
    for i, (_, stage) in enumerate(cp.STAGES):
        path = str(folder / str(i))
        stage(spark, out[-1], "unused").write.parquet(path)
        out.append(spark.read.parquet(path))
    return [[tuple(r) for r in x.collect()] for x in out], [x.columns for x in out]


def test_order_and_columns(staged):
    assert [k for k, _ in cp.STAGES] == ["language ID", "n-gram join", "personal data", "source mix", "SentencePiece"]
    assert all(c == staged[1][0] for c in staged[1][:-1])
    assert all(r[5:] == ("kept",) * len(CLASH) for x in staged[0][:-1] for r in x)


def test_language_keeps_all_with_letters(staged):
    before, after = staged[0][0], staged[0][1]
    lettered = [r for r in before if r[1] and re.search(r"[^\W\d_]", r[1]) and r[0] != 303]  # 303 repeats one word
    assert sorted((str(r[0]), r[1]) for r in after) == sorted((str(r[0]), r[1]) for r in lettered)
    assert all(r[2] in ("xx", "yy") for r in after)


def test_one_document_of_each_group_stays(staged):
    before, after = staged[0][1], staged[0][2]
    named = [(r[0], r[1]) for r in before if r[0] is not None]
    firsts = {d for d, (_, c) in brute_groups(named).items() if d == c}
    assert sorted(r[0] for r in after if r[0] is not None) == sorted(firsts)
    assert sum(r[0] is None for r in after) == 1


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    long = " ".join(f"w{i}" for i in range(40))
    data = [(5, "one text of this id", 1), (5, "and here is another text", 2), (5, "one text of this id", 3), (9, long, 1), (9, long + " more", 2), (7, long, 3), (7, "seven has this too", 1), (8, "", 1), (8, None, 2), (None, long, 1), (None, None, 2)]
    docs = spark.createDataFrame(data, "doc_id long, text string, x int").repartition(3)
    got = Counter((r["doc_id"], (r["text"] or "").removesuffix(" more")) for r in cp.near_duplicates(spark, docs, "unused").collect())
    assert got == {(5, "one text of this id"): 1, (5, "and here is another text"): 1, (7, long): 1, (7, "seven has this too"): 1, (8, ""): 2, (None, long): 1, (None, ""): 1}


@pytest.mark.parametrize("sent", [1000, 0])
def test_dropped_rows_go_to_the_texts_where_few(spark, monkeypatch, sent):
    """Texts are not shuffled to lose their copies; with many dropped rows the result is the same."""
    monkeypatch.setattr(cp, "SENT_ROWS", sent)
    docs = spark.createDataFrame([(i, f"text number {i // 2} of a few", "xx") for i in range(40)] + [(None, "no id", "xx")] * 2, "doc_id long, text string, lang string").repartition(3)
    out = cp.near_duplicates(spark, docs, "unused")
    assert sorted(r["doc_id"] or -1 for r in out.collect()) == [-1, -1, -1, *range(2, 40, 2)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert not sent or not any("Exchange" in x and "text" in x for x in plan.splitlines())


def test_a_table_without_languages_keeps_its_texts(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "1 2", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in cp.language(spark, docs, "unused").collect()] == [1]


def test_personal_data_is_replaced(staged):
    before = {r[0]: r[1] for r in staged[0][2]}
    for doc_id, text, _, _, n, *_ in staged[0][3]:
        want, at = "", 0
        for a, b, k in sorted((a, b, k) for k, a, b in brute_spans(before[doc_id])):
            if a >= at:
                want += before[doc_id][at:a] + f"[{k.upper()}]"
            at = max(at, b)
        assert text == want + before[doc_id][at:] and n == len(text)


def test_mix_repeats_whole_documents(staged):
    before, after = staged[0][3], staged[0][4]
    times = Counter(r[0] for r in after)
    assert set(times) <= {r[0] for r in before} and max(times.values()) <= 3
    size = lambda r: len(r[1].split())
    total = sum(map(size, before))
    assert abs(sum(map(size, after)) - total) <= 3 * max(map(size, before))


def test_pieces_are_the_librarys(staged):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    want = sorted((str(r[0]), str(library.encode(r[1], num_threads=1))) for r in staged[0][4])
    assert sorted((str(r[0]), str(list(r[1]))) for r in staged[0][5]) == want


def test_run(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = cp.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "ids", "n_ids", "round_trip"] and out.count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert cp.run(spark, str(tmp_path / "none")).count() == 0
