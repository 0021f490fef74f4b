import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from airgrid.llm import best_fit_packing, common, exact_search, language_id, ngram_join, queries, suffix_dedup

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", None, None) for i, t in enumerate(texts)], SHAPE)


def doc_texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def shingles(text):
    words = WORDS.findall((text or "").translate(LOW))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(texts):
    sets, parent, holders = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}, defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in sets.items():
        common_with = defaultdict(int)
        for s in own:
            for j in holders[s]:
                common_with[j] += 1
            holders[s].append(i)
        for j, n in common_with.items():
            if 100 * n >= 75 * (len(own) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in texts}


def brute_removed(rows, window=400):
    counts = defaultdict(int)
    for _, raw in rows:
        for k in range(len(raw) - window + 1):
            counts[raw[k : k + window]] += 1
    out = []
    for i, raw in rows:
        mask, end, spans = np.zeros(len(raw), bool), -1, 0
        for k in range(len(raw) - window + 1):
            if counts[raw[k : k + window]] > 1:
                mask[max(k, end) : k + window] = True
                spans += k > end
                end = k + window
        kept = bytes(np.frombuffer(raw, np.uint8)[~mask])
        out.append((i, len(raw), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(n))


COPIES = [prose(1, 120), prose(1, 120), prose(1, 120) + " tail", "a b c", "A b  c", "", None, " ", "one two three four five", "x " * 600, prose(2, 80) + " " + prose(1, 100)]


def test_join_on_tables_and_odd_rows(spark, sf_dir):
    for table, texts in ((spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_texts(spark, sf_dir)), (frame(spark, COPIES).withColumn("rep", F.lit("clash")), dict(enumerate(COPIES)))):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(table).collect()}
        assert got == brute_components(texts)
    assert ngram_join.jaccard_components(frame(spark, COPIES).limit(0)).count() == 0


def test_join_with_small_blocks_and_shuffled_texts(spark, monkeypatch):
    base = prose(5, 150).split()
    texts = [" ".join(base[:k] + ["w%d" % k] + base[k + 1 :]) for k in range(0, 150, 6)] + [" ".join(base[: 150 - 3 * k]) for k in range(14)] + [prose(k, 90) for k in range(20)]
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 3)
    monkeypatch.setattr(common, "SMALL_ROWS", 0)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, texts)).collect()}
    assert got == brute_components(dict(enumerate(texts)))


def test_join_keeps_links_of_a_groups_smaller_members(spark):
    words = ["w%d" % k for k in range(104)]
    texts = [" ".join(words), " ".join(words[1:]), " ".join([*words[23:], "x", "y", "z"])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, texts).coalesce(1)).collect()}
    assert got == brute_components(dict(enumerate(texts))) == {0: (100, 0), 1: (99, 0), 2: (80, 0)}


@pytest.mark.parametrize("group", [64, 2])
def test_dedup_removes_the_repeated_bytes(spark, sf_dir, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", group)
    part = prose(9, 90)
    odd = [*COPIES, "é" * 500, "be " * 400, "xé" + part, "q" + part + "r", prose(3, 40) + part + prose(4, 40), part[:399], part[:400]]
    docs = frame(spark, odd).union(frame(spark, odd[:1])).withColumn("hash", F.lit(1)).withColumn("start", F.lit("x"))
    rows = [(i, (t or "").encode()) for i, t in [*enumerate(odd), (0, odd[0])]]
    got = suffix_dedup.dedup(docs).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(brute_removed(rows))
    assert set(docs.columns) < set(got[0].asDict())
    if group == 64:
        texts = [(i, (t or "").encode()) for i, t in doc_texts(spark, sf_dir).items()]
        assert sorted(map(tuple, queries.op2_suffix_dedup(spark, sf_dir).collect())) == sorted(brute_removed(texts))
        assert suffix_dedup.dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("group", [64, 2])
def test_dedup_joins_rows_without_id(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", group)
    part = prose(9, 90)[:450]
    texts = [(None, prose(3, 40) + part + prose(4, 40)), (7, prose(5, 40) + part + prose(6, 40)), (None, prose(7, 40) + part + prose(8, 40)), (3, prose(3, 40) + part + prose(4, 40)), (None, prose(10, 90))]
    rows = [(i, t.encode()) for i, t in texts]
    for source in (rows, rows[:2]):
        docs = spark.createDataFrame([(i, raw.decode()) for i, raw in source], "doc_id long, text string")
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs).collect()]
        expected = brute_removed(source)
        assert all(removed >= 450 for _, n, removed, _, _ in expected[:4])
        assert sorted(got, key=str) == sorted(expected, key=str)


def test_suffix_order_and_extensions():
    rows = [suffix_dedup.Suffix(x, 2, 0) for x in (b"xxbanana", b"yxband", b"xxban", b"zzapple", b"xxbanana")]
    order, agree = suffix_dedup.sorted_suffixes(rows)
    assert [rows[i].around[2:] for i in order] == [b"apple", b"ban", b"banana", b"banana", b"band"] and agree == [0, 0, 3, 6, 3]
    assert suffix_dedup.extension(rows[0], rows[1], "left") == 1


def test_packing(spark, sf_dir):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {**doc_texts(spark, sf_dir), -1: None, -2: "", -3: "It's <|endoftext|> ÉÀ. İx\x1cy", -4: "w " * 9000, -5: " a b\r\n"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("piece", F.lit("clash"))
    got = best_fit_packing.pack(best_fit_packing.token_pieces(docs)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, text in texts.items():
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in sorted(by_doc[i])] == [(k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(by_sequence) <= 1.02 * -(-sum(r.length for r in got) // 4096) + 1
    assert best_fit_packing.pack(best_fit_packing.token_pieces(docs.limit(0))).count() == 0


def test_partitions_exchange_pieces(spark, monkeypatch):
    monkeypatch.setattr(best_fit_packing, "PARTITION_ROWS", 40)
    sizes = np.random.default_rng(3).integers(1, 101, 400).tolist()
    got = best_fit_packing.pack(spark.createDataFrame(list(enumerate(sizes)), "id long, length long"), 100).collect()
    assert sorted((r.id, r.length) for r in got) == list(enumerate(sizes))
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 100
    assert best_fit_packing.lower_bound(np.array(sizes), 100) <= len(held) <= 1.1 * best_fit_packing.lower_bound(np.array(sizes), 100)
    assert best_fit_packing.lower_bound(np.array([51] * 5), 100) == 5 and best_fit_packing.lower_bound(np.array([34] * 6), 100) == 3


def test_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries.op7_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)
    texts = {r.lang: r.text for r in docs.where("length(text) > 2000").select("lang", "text").collect()}
    a, b = sorted(texts)[:2]
    odd = spark.createDataFrame([(0, None, 1), (1, "", 1), (2, "12 !?", 1), (3, texts[a][:1500] + " " + texts[b][:1500], 1), (None, texts[a], 1), (5, "é", 1)], "doc_id long, text string, score int")
    model = language_id.learned(docs)
    rows = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert [rows[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and set(rows[3].lang_set) == {a, b} and rows[None].lang_pred == a and rows[5].lang_pred in model[0]
    none = language_id.learned(docs.limit(0))
    assert none[0] == [] and language_id.predict(odd, none).where("lang_pred <> 'und'").count() == 0 and language_id.predict(odd.limit(0), model).count() == 0


def test_search(spark, sf_dir, monkeypatch):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    expected = {tuple(map(int, r)) for r in con.sql(f"SELECT query_id, rank, vec_id, score FROM ({queries.ORACLES['op8_exact_search']})").fetchall()}
    for rows in (4096, 60):
        monkeypatch.setattr(exact_search, "BLOCK_ROWS", rows)
        monkeypatch.setattr(exact_search, "QUERY_ROWS", max(1, rows // 8))
        assert {tuple(r) for r in queries.op8_exact_search(spark, sf_dir).collect()} == expected
    # Far clusters: balls that cannot reach the k-th score are never sent, and nothing is lost.
    rng = np.random.default_rng(2)
    heads = rng.normal(size=(12, 8)) * 3
    rows = [(k, (heads[k % 12] + rng.normal(size=8) * 0.05).tolist()) for k in range(1500)]
    clustered = exact_search.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    whole = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64)
    want = []
    for i in range(0, 1500, 20):
        score = whole @ whole[i]
        want += [(i, r, int(j), int(score[j])) for r, j in enumerate([j for j in np.lexsort((np.arange(1500), -score)) if j != i][:20], 1)]
    monkeypatch.setattr(exact_search, "BLOCK_ROWS", 100)
    assert sorted(tuple(r) for r in exact_search.top_k(clustered).collect()) == sorted(want)
    odd = spark.createDataFrame([(0, [1.0, 0.5], "x"), (20, [1.0, 0.5], "x"), (1, None, "x"), (40, [float("nan"), 1.0], "x"), (2, [None, 1.0], "x"), (None, [1.0, 1.0], "x"), (3, [0.1, -0.1], "x"), (0, [1.0, 0.5], "x")], "vec_id long, embedding array<double>, v string")
    got = exact_search.top_k(exact_search.integer_vectors(odd)).collect()
    zero = [(0, 1, 0, 5120), (0, 2, 20, 5120), (0, 3, 3, 160)]
    assert sorted(tuple(r) for r in got) == sorted([*zero, *zero, (20, 1, 0, 5120), (20, 2, 0, 5120), (20, 3, 3, 160)])
    assert exact_search.top_k(exact_search.integer_vectors(odd.limit(0))).count() == 0


def test_pipeline_against_plain_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = doc_texts(spark, sf_dir)
    first = corpus_pipeline.language_stage(spark, docs, sf_dir)
    assert first.columns == docs.columns and {r.doc_id for r in first.select("doc_id").collect()} == {i for i, t in texts.items() if t and any(map(str.isalpha, t))}
    second = common.written(corpus_pipeline.near_copy_stage(spark, first, sf_dir))
    kept = {r.doc_id: r.text for r in second.collect()}
    assert set(kept) == {i for i, (_, c) in brute_components(texts).items() if i == c}
    third = common.written(corpus_pipeline.repeated_passage_stage(spark, second, sf_dir))
    plain = {i: (n, removed, sha) for i, n, removed, _, sha in brute_removed([(i, t.encode()) for i, t in kept.items()], corpus_pipeline.PASSAGE_BYTES)}
    got = {r.doc_id: r for r in third.collect()}
    assert set(got) == {i for i, (n, removed, _) in plain.items() if not removed or removed < n}
    assert all(r.text == kept[i] if not plain[i][1] else r.n_chars == len(r.text) for i, r in got.items())
    fourth = common.written(corpus_pipeline.secret_stage(spark, third, sf_dir))
    assert fourth.columns == docs.columns and fourth.where(F.col("text").rlike("[0-9a-f]{16,}|AKIA[A-Z0-9]{14,}")).count() == 0
    assert {r.doc_id for r in corpus_pipeline.packing_stage(spark, fourth, sf_dir).collect()} == set(got)


def test_stages_take_odd_tables(spark):
    docs = frame(spark, [*COPIES, "token = 'abcdefghijklmnop'"]).union(frame(spark, COPIES[:1]))
    for source in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = common.written(stage(spark, source, ""))
            if stage is not corpus_pipeline.packing_stage:
                assert out.schema.names == source.schema.names
                source = out


def test_word_ids_equal_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from airgrid.llm import best_fit_packing as packing

    texts = ["Ab cD", None, "", "  x  y ", "a\nb\r\nc\td", "É é İ Σας ΣΑΣ", "end", "start end", "日本語 \U0001f600 naïve", "A" * 300, "\x00 a b"]
    plain = Tokenizer.from_file(packing.TOKENIZER)
    words = packing.WordIds(packing.TOKENIZER)
    for some in (texts, texts[::-1], texts[:1], []):
        got = [x.tolist() for x in words.encode(pa.array(some, pa.string()))]
        assert got == [plain.encode(x or "", add_special_tokens=False).ids for x in some]


def test_stages_keep_columns_with_the_operators_names(spark, sf_dir):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    clash = docs.withColumns({c: F.col("doc_id") * 2 for c in ("score", "lang_pred", "n_bytes", "n_removed", "n_spans", "kept_text", "secret_spans", "__masked")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, sf_dir)
        assert out.columns == clash.columns
        assert out.where("score <> doc_id * 2 or n_bytes <> doc_id * 2 or kept_text <> doc_id * 2 or secret_spans <> doc_id * 2 or __masked <> doc_id * 2").count() == 0


def test_passages_of_fifty_words_go(spark):
    import random

    import corpus_pipeline

    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(55)
    rows = [(k, f"{text(60)} {shared} {text(60)}" if k < 6 else text(150), "en", "s", 1) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in corpus_pipeline.repeated_passage_stage(spark, docs, "").collect()}
    assert len(out) == 12
    for k, t, *_ in rows:
        assert (out[k].text == t) == (k >= 6)
        if k < 6:
            assert shared[10:-10] not in out[k].text and out[k].n_chars == len(out[k].text)
