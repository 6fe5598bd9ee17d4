"""The operators against plain versions, with nulls, ties, repeats, empties and long texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import ann, language_id, source_mix, topk, url_filter, warc_fixity
from corpuslens.llm.common import tokenizer, written
from corpuslens.llm.sentencepiece_codec import Codec, Model, decode, encode
from corpuslens.llm.token_count import PairTable, count_tokens

ODD = [None, "", " ", "\n\n", "a" * 3000, "the quick brown fox's don't 12345 3.14", "héllo ☃ 日本語 😀", "x▁y", "<s>hi</s><|endoftext|>", "\x00a\x1c", "  lead and trail  ", "aaa" * 700 + " end"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- URL filters


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    best = None
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best and best[0], best[1] if best else "allow"


@pytest.mark.parametrize("inline", [url_filter.INLINE_RULES, 0])
def test_url_rules(spark, inline):
    rules = [(r.name, r.verdict) for r in url_filter.LIST_RULES] + [("b.org/x", "block")]
    urls = [None, "", "no scheme", "http://example.com", "http://example.com/", "http://EXAMPLE.com/en/1", "https://www.example.com/en/?q=/es/", "http://m.example.com/en/2#a/b", "http://a.net/es/3", "http://a.net/es", "http://a.net/ES/", "http://com/x", "http://notexample.com/en/", "http://b.org/xyz", "http://b.org/Xyz", "a://b://c.net/fr/", "http://a.net/fr/\nline", "http://x.org/wp-login.php?a", "http://com?x=1", "http://com/x"]
    pages = spark.createDataFrame([(i, u, "a", "b") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, rules=[url_filter.host_path_rule(*r) for r in rules], inline=inline).collect()}
    for i, u in enumerate(urls):
        want = plain_verdict(u, rules)
        if i == 17:
            want = (*want[:3], "block")
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == want, u
    assert url_filter.judge_urls(pages.limit(0), inline=inline).collect() == []


def test_rarest_token_is_the_index():
    rule = url_filter.host_path_rule("example.com/en/", "block")
    assert url_filter.rule_index([rule], {"com": 9, "example": 5, "en": 7}) == ["example"]
    assert url_filter.host_path_rule("a.b/en", "block").tokens == ("a", "b")


# --- exact top-k


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)


def brute_top(rows, k=5, scale=256):
    """Whole numbers of any size, every row a query or candidate of its own."""
    fine = lambda e: e is not None and all(x is not None and np.isfinite(x) for x in e)
    usable = [(i, [int(np.floor(scale * np.float64(np.float32(x)))) for x in e]) for i, e, _ in rows if i is not None and fine(e)]
    out = []
    for at, (i, q) in enumerate(usable):
        if i % 50:
            continue
        scores = [(-max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(q, e, strict=True)))), j) for other, (j, e) in enumerate(usable) if other != at and len(e) == len(q)]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_is_exact(spark, seed):
    rnd = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rnd.normal(size=4)], "s") for i in range(300)]
    rows += [(1000 + i, [0.5, 0.5, 0.25, -1.0], "s") for i in range(400)]  # many ties
    rows += [(5000, None, "s"), (5050, [1.0, None, 0.0, 0.0], "s"), (5100, [float("nan")] * 4, "s"), (5150, [float("inf")] * 4, "s"), (5200, [1.0], "s"), (5250, [], "s"), (None, [1.0] * 4, "s"), (5300, [0.0] * 4, "s")]
    got = topk.search(vectors(spark, rows), F.col("vec_id") % 50 == 0, k=5)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute_top(rows)


def test_top_k_of_large_components_repeated_ids_and_lengths(spark):
    big = [(0, [100000.0, 1.0]), (100000, [100000.0, 0.0]), (1, [100000.0, 0.0]), (2, [200000.0, 0.0]), (50, [3e9, -2e9]), (3, [2e9, 3e9]), (4, [3e9, 2e9]), (100, [1e30, -1e30]), (5, [-1e30, 1e30]), (6, [2.0**60, 2.0**60])]
    rows = [(i, e, "s") for i, e in big]
    rows += [(0, [1.0, 2.0], "s"), (0, [1.0, 2.0], "s"), (0, [-1.0, 2.0], "s")]  # three more rows of one id ask
    rows += [(150, [1.0, 2.0, 3.0], "s"), (7, [1.0, 0.0, 3.0], "s"), (8, [1.0, 1.0, 3.0], "s"), (200, [], "s"), (9, [], "s")]
    rows += [(50, [0.5, 0.5, 0.5, 0.5], "s")] * 300  # one id and vector in most rows
    got = topk.search(vectors(spark, rows), F.col("vec_id") % 50 == 0, k=3)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute_top(rows, 3)


def test_top_k_of_few_and_none(spark):
    rows = [(0, [1.0, 0.0, 0.0, 0.0], "s"), (1, [0.5, 0.0, 0.0, 0.0], "s")]
    got = topk.search(vectors(spark, rows), F.col("vec_id") % 50 == 0, k=5, block=1)
    assert [tuple(r) for r in got.collect()] == [(0, 1, 1, 256 * 128)]
    assert topk.search(vectors(spark, rows).limit(0), F.col("vec_id") % 50 == 0).collect() == []
    assert topk.search(vectors(spark, rows[:1]), F.col("vec_id") % 50 == 0).collect() == []


# --- nearest neighbours


def test_neighbours_recall_and_scores(spark):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(40, 32))
    x = (centres[rnd.integers(0, 40, 3000)] + 0.7 * rnd.normal(size=(3000, 32))).astype(np.float32)
    x[2000:2500] = x[2000]  # equal vectors: ties go to smaller ids
    rows = [(int(i), [float(v) for v in e], "s") for i, e in enumerate(x)] + [(9000, [0.0] * 32, "s"), (9050, None, "s"), (9100, [float("nan")] * 32, "s")]
    got: dict = {}
    for r in ann.search(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        cos = y @ y[q]
        cos[q] = -9
        best = [int(i) for i in np.lexsort((np.arange(3000), -np.round(cos, 12)))[:5]]
        found = sorted(got[q])
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert all(abs(s - cos[i]) < 1e-12 for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(best))
    assert sorted(got) == list(range(0, 3000, 50)) and hits / (5 * 60) >= 0.9
    assert [i for _, i, _ in sorted(got[2000])] == [2001, 2002, 2003, 2004, 2005]


def test_neighbours_among_near_copies(spark):
    """A third of the rows are near copies of one vector, far more than a first batch."""
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(6_000, 32))
    x[::3] = x[0] + 0.05 * rnd.normal(size=(2_000, 32))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    rows = [(i, v.tolist(), "s") for i, v in enumerate(x)]
    got: dict = {}
    for r in ann.search(vectors(spark, rows).repartition(2), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    exact = np.array([v for _, v, _ in rows]).astype(np.float32).astype(np.float64)
    exact /= np.sqrt((exact * exact).sum(axis=1, keepdims=True))
    for q in range(0, 6_000, 50):
        score = exact @ exact[q]
        score[q] = -2
        assert got[q] == np.argsort(-score, kind="stable")[:5].tolist(), q


def test_neighbours_of_few_and_none(spark):
    rows = [(0, [1.0, 0.0], "s"), (1, [1.0, 1.0], "s")]
    assert [(r["vec_id"], round(r["score"], 9)) for r in ann.search(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()] == [(1, round(0.5**0.5, 9))]
    assert ann.search(vectors(spark, rows).limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_neighbours_of_repeated_ids_and_lengths(spark):
    rows = [(0, [1.0, 0.0], "s"), (0, [0.0, 1.0], "s"), (0, [0.0, 1.0], "s"), (1, [2.0, 0.1], "s"), (50, [1.0, 2.0, 3.0], "s"), (2, [3.0, 2.0, 1.0], "s"), (100, [4.0], "s"), (150, [], "s"), (200, [None, 1.0], "s")]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.search(vectors(spark, rows), F.col("vec_id") % 50 == 0, k=2).collect())
    near, far = round(2 / 4.01**0.5, 6), round(0.1 / 4.01**0.5, 6)
    assert got == sorted([(0, 1, 1, near), (0, 2, 0, 0.0), (0, 1, 0, 1.0), (0, 2, 1, far), (0, 1, 0, 1.0), (0, 2, 1, far), (50, 1, 2, round(10 / 14, 6))])


# --- WARC fixity


def test_audit_finds_exactly_the_faults(spark):
    n, bad, lost = 700, {3, 250, 251, 699}, {17, 600}
    rows = [(i, f"record {i} é", None if i in lost else "changed" if i in bad else f"record {i} é", "x") for i in range(n)] + [(5, "record 5 é", "record 5 é", "x"), (None, "", "", "x")]
    records = spark.createDataFrame(rows, "page_id long, record string, replica string, digest string")
    got = warc_fixity.audit(records, key="page_id", record="record", replica="replica", archive_records=200, fanout=4).collect()
    assert len(got) == len(rows)
    assert {r["key"] for r in got if r["status"] == "corrupt"} == bad and {r["key"] for r in got if r["status"] == "missing"} == lost
    by: dict = {}
    for r in got:
        by.setdefault(r["archive"], []).append((r["position"], r["offset"], r["length"]))
        assert (r["root"] == r["replica_root"]) == (r["archive"] not in {x["archive"] for x in got if x["status"] != "ok"})
    for parts in by.values():
        at = 0
        for i, (position, offset, length) in enumerate(sorted(parts)):
            assert (position, offset) == (i, at)
            at += length
    assert warc_fixity.audit(records.limit(0), key="page_id", record="record", replica="replica").collect() == []


def test_records_of_one_side_only(spark):
    rows = [(1, "a", "a"), (2, None, "b"), (3, "c", None), (4, None, None), (5, "x" * 3_000_000, "x" * 2_999_999 + "y")]
    records = spark.createDataFrame(rows, "page_id long, record string, replica string")
    got = {r["key"]: (r["status"], r["length"]) for r in warc_fixity.audit(records, key="page_id", record="record", replica="replica", archive_records=2, fanout=2).collect()}
    assert got == {1: ("ok", 1), 2: ("extra", 0), 3: ("missing", 1), 4: ("ok", 0), 5: ("corrupt", 3_000_000)}


def test_descent_reads_only_folders_of_differing_archives(spark):
    def levels(bad):
        rows = [(i, f"record {i}", "changed" if i in bad else f"record {i}") for i in range(300)]
        leaves = warc_fixity.manifest(spark.createDataFrame(rows, "key long, record string, replica string"), "key", "record", "replica", 30)
        return leaves, warc_fixity.trees(written(leaves, "leaves", by="shard"), 4)

    leaves, made = levels({7})
    [shard] = [r["shard"] for r in leaves.filter("key = 7").collect()]
    found = warc_fixity.differing(made, 4)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^]]*shard#\d+L? (IN \({shard}\)|= {shard})\b", text)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in leaves.filter("key = 7").select("archive", "position").collect()]
    equal = warc_fixity.differing(levels(set())[1], 4)
    assert "shard" not in equal._jdf.queryExecution().executedPlan().toString() and equal.collect() == []


def test_roots_are_merkle_roots(spark):
    records = spark.createDataFrame([(i, f"r{i}", f"r{i}") for i in range(9)], "page_id long, record string, replica string")
    leaves = [hashlib.sha256(f"r{i}".encode()).hexdigest() for i in range(9)]
    level = leaves
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + 3]).encode()).hexdigest() for i in range(0, len(level), 3)]
    [root] = {r["root"] for r in warc_fixity.audit(records, key="page_id", record="record", replica="replica", fanout=3).collect()}
    assert root == level[0]


def test_records_are_warc(spark):
    row = spark.createDataFrame([(1, "http://a/é", "<p>é</p>")], "p long, u string, h string").select(warc_fixity.response_record(F.col("p"), F.col("u"), F.col("h")).alias("r")).first()["r"].encode()
    head, body = row.split(b"\r\n\r\n", 1)
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    assert head.startswith(b"WARC/1.0\r\n") and body[size:] == b"\r\n\r\n" and body[:size].endswith("<p>é</p>".encode())


# --- SentencePiece


def texts(path):
    rnd = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz    eeettaaooiinnssrr  THE.,'\"0123456789éß日😀\n\t"
    pieces = [p for p in Model(path).pieces if p]
    out = [*ODD]
    out += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 200))) for _ in range(300)]
    out += ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 40))).replace("▁", " ") for _ in range(300)]
    return out


def test_pieces_are_the_librarys(spark):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [*enumerate(texts(path))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string").repartition(3)
    coded = encode(docs, path)
    got = {r["doc_id"]: r for r in coded.collect()}
    back = {r["doc_id"]: r["text"] for r in decode(coded, path).collect()}
    for i, t in rows:
        want = library.encode(t or "", num_threads=1)
        assert got[i]["ids"] == want and got[i]["n_ids"] == len(want), t
        assert back[i] == library.decode(want)
        assert got[i]["round_trip"] == (back[i] == (t or ""))
    assert encode(docs.limit(0), path).collect() == []


def test_lattice_gets_each_word_once_whatever_stands_beside_it(monkeypatch):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(4 + i % 12)) for i in range(300)]
    texts = [" ".join(f"{w}{rnd.choice(['', ',', '.', '!!', '%%%', ')', '7', '29', '日', '😀'])}" for w in rnd.sample(words, 300)) for _ in range(20)]
    coded, plain = [], Model._viterbi
    monkeypatch.setattr(Model, "_viterbi", lambda self, batch, *rest: coded.append(sum(map(len, batch))) or plain(self, batch, *rest))
    codec = Codec(Model(path))
    for text in texts:
        ids, sizes = codec.encode([text])
        assert ids.tolist() == library.encode(text, num_threads=1) and sizes.tolist() == [len(ids)]
    assert sum(coded) <= sum(len(w) + 1 for w in words) + 50  # a mark before each word; punctuation, digits
    assert len(coded) <= 40  # words of like length advance together


@pytest.mark.parametrize("with_bytes", [True, False])
def test_no_piece_crosses_words(with_bytes):
    model = object.__new__(Model)
    model.bytes = np.arange(256) if with_bytes else None
    pieces = ["▁", "a", "b", "ab", "▁ab", ".", "..", "▁.", "-", "]", "^", "7", "x", "xy", "▁▁"]  # y is no piece by itself
    word = re.compile(model._word_pattern(pieces))
    rnd = random.Random(8)
    for _ in range(500):
        text = "".join(rnd.choice("▁▁aabb..-]^7xyyé\n😀") for _ in range(rnd.randrange(1, 30)))
        found = word.findall(text)
        assert "".join(found) == text
        cuts = {len("".join(found[:k])) for k in range(1, len(found))}
        for i in range(len(text)):
            for p in pieces:
                if text.startswith(p, i):
                    assert not cuts & {*range(i + 1, i + len(p))}, (text, found)
            if not with_bytes and i and not {text[i - 1], text[i]} & {*pieces}:
                assert i not in cuts, (text, found)  # a run of unknown characters is one piece


def test_unigram_viterbi_finds_the_best_sum():
    from itertools import combinations

    model = object.__new__(Model)
    rnd = random.Random(9)
    model.pieces = ["<unk>", *sorted({"".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 5))) for _ in range(14)} | {"a"})]
    model.kind, model.unknown, model.bytes = 1, 0, None
    model.scores = np.array([0.0, *(-rnd.random() * 5 for _ in model.pieces[1:])])
    model.unknown_score, model.longest = -20.0, 4
    keys = np.array([Model._key(p) for p in model.pieces[1:]], np.uint64)
    order = np.argsort(keys)
    model.keys, model.ids = keys[order], order + 1
    score = dict(zip(model.pieces[1:], model.scores[1:], strict=True))
    for _ in range(40):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9)))
        best = max(sum(score.get(word[i:j], -20.0 if j - i == 1 else -1e9) for i, j in zip((0, *c), (*c, len(word)), strict=True)) for k in range(len(word)) for c in combinations(range(1, len(word)), k))
        [ids] = model.encode_words([word])
        total = sum(model.scores[i] if i else 0 for i in ids.tolist())
        known = sum(len(model.pieces[i]) for i in ids.tolist() if i)
        assert abs(total - 20.0 * (len(word) - known) - best) < 1e-9


# --- token counts


def test_counts_are_the_librarys(spark):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [*enumerate([*texts(tokenizer("piece_bpe_32k.model")), "I'll we've 'S 's" * 5, "x<|endoftext|><|endoftext|> y", "".join(chr(i) for i in range(1, 0x2100)), "ab" * 20_000])]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_tokens int").repartition(3)
    got = {r["doc_id"]: r for r in count_tokens(docs, path).collect()}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert tuple(got[i])[1:] == (len((t or "").encode()), n, n > 1024), t
    assert count_tokens(docs.limit(0), path).collect() == []


def test_pair_table():
    rnd = np.random.default_rng(0)
    keys = np.unique(rnd.integers(0, 2**40, 5000))
    table = PairTable(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(rnd.integers(0, 2**40, 5000), keys)
    assert (table.find(other) == 2**31 - 1).all()


# --- source mix


def plain_targets(sizes, most=3):
    """Share by weight, stop at the limit, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("range_rows", [20_000, 20])
def test_mix(spark, monkeypatch, range_rows):
    monkeypatch.setattr(source_mix, "RANGE_ROWS", range_rows)
    rnd = random.Random(4)
    names = ["src0"] * 10 + ["a", "é", "Z", None, "tiny"]
    rows = []
    for i in range(600):
        s = rnd.choice(names) if i < 599 else "tiny"
        rows.append((i, " ".join("w" * rnd.randrange(1, 4) for _ in range(rnd.randrange(0, 2 if s == "tiny" else 40))), s, 0))
    rows += [(1000, None, "nulls", 0), (1001, "", "nulls", 0), (7, "twice twice", "a", 0), (7, "twice twice", "a", 0), (None, "no id", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = source_mix.mix_sources(docs).collect()
    sizes: dict = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want, taken = plain_targets(sizes), {}
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        took = r["epochs"] * r["size"] + r["part"]
        assert 0 <= took <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + took
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in want)
    assert sorted(map(str, got)) == sorted(map(str, source_mix.mix_sources(docs.repartition(7)).collect()))
    assert source_mix.mix_sources(docs.limit(0)).collect() == []


def test_repeats(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "c d", "s"), (3, "e f", "s")], "doc_id long, text string, source string")
    mix = spark.createDataFrame([(1, 2, "s", 2, 0), (2, 2, "s", 1, 1), (3, 2, "s", 0, 0)], "doc_id long, size long, source string, epochs long, part long")
    assert sorted(r["doc_id"] for r in source_mix.repeat_documents(docs, mix).collect()) == [1, 1, 2, 2]


def test_repeats_of_null_ids_in_several_sources(spark):
    rows = [(None, "a b c", "p")] * 60 + [(None, "d e f", "q")] * 40 + [(None, "g h", None)] * 20 + [(1, "x y z", "q"), (1, "x", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    mix = source_mix.mix_sources(docs)
    target = {r["source"]: r["target"] for r in mix.collect()}
    took: dict = {}
    for r in source_mix.repeat_documents(docs, mix).collect():
        took[r["source"]] = took.get(r["source"], 0) + len(r["text"].split())
    assert all(abs(took[s] - target[s]) <= 0.25 * target[s] + 6 for s in target), (took, target)


# --- language ID


def plain_vector(text, dimensions=language_id.DIMENSIONS):
    """Trigrams within words and their neighbouring spaces, one by one."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    run = re.sub(" +", " ", f" {letters} ")
    known = lambda c: np.random.Generator(np.random.PCG64(1_000_003 + (0 if c == " " else ord(c)))).integers(0, 2, dimensions, np.int8).astype(np.int64) * 2 - 1
    out = np.zeros(dimensions, np.int64)
    for i in range(len(run) - 2):
        if run[i + 1] != " ":
            out += np.roll(known(run[i]), 2) * np.roll(known(run[i + 1]), 1) * known(run[i + 2])
    return out


def test_predictions_equal_plain_cosines(spark):
    rnd = random.Random(9)
    rows = [(i, "".join(rnd.choice("abcdeé日 ,1\n") for _ in range(rnd.randrange(0, 60))), rnd.choice(["b", "a", None])) for i in range(60)]
    rows += [(100, None, "a"), (101, "", "b"), (102, "12 !", "a"), (103, "abc abc", "a"), (None, "abc abc", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    sums: dict = {}
    for i, t, lang in rows:
        if i is not None and lang and t is not None and zlib.crc32(str(i).encode()) % 5:
            v = plain_vector(t)
            sums[lang] = sums.get(lang, 0) + v / max(np.linalg.norm(v), 1e-9)
    names = sorted(sums)
    for r in language_id.identify_language(docs).collect():
        [text] = {t for i, t, _ in rows if i == r["doc_id"]}
        v = plain_vector(text)
        if not v.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cosine = [v @ sums[k] / np.linalg.norm(v) / np.linalg.norm(sums[k]) for k in names]
        assert abs(r["score"] - max(0.0, *cosine)) < 1e-4 and cosine[names.index(r["lang_pred"])] > max(cosine) - 1e-4


def test_equal_prototypes_go_to_the_smaller_name(spark):
    docs = spark.createDataFrame([(i, "the same text", lang) for i, lang in enumerate(["z", "m"] * 20)], "doc_id long, text string, lang string")
    v = language_id.Encoder().vectors(["the same text"])[0].astype(float)
    got = language_id.identify(docs, {"m": v, "z": v.copy()}, keep=("doc_id",)).collect()
    assert {r["lang_pred"] for r in got} == {"m"}



def test_languages(spark):
    rnd = random.Random(8)
    stems = {"aa": ["the", "ing", "wh", "ough", "tion"], "bb": ["ção", "ões", "que", "nh", "lh"], "cc": ["sch", "ung", "ein", "ich", "ß"]}
    say = lambda s, n: " ".join("".join(rnd.choice(stems[s]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))
    rows = [(i, say(s, 60), s, 0.5) for i, s in enumerate(rnd.choice([*stems]) for _ in range(400))]
    rows += [(1000, None, "aa", 0.5), (1001, "", None, 0.5), (1002, "12 3.4 !!", "bb", 0.5), (None, say("aa", 60), "bb", 0.5), (1003, say("cc", 120_000), None, 0.5), (1004, say("bb", 60), None, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(4)
    got = {r["doc_id"]: r for r in language_id.identify_language(docs).collect()}
    right = 0
    for i, _, lang, _ in rows[:400]:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i]["score"] <= 1
        right += got[i]["lang_pred"] == lang
    assert right >= 395
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] == "cc" and got[1004]["lang_pred"] == "bb" and got[None]["lang_pred"] == "aa" and not got[None]["held_out"]
    assert language_id.identify_language(docs.limit(0)).collect() == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string")).limit(3)
    assert {r["lang_pred"] for r in language_id.identify_language(unlabelled).collect()} == {"und"}
    assert sorted(map(str, language_id.identify_language(docs.repartition(2)).collect())) == sorted(map(str, got.values()))
