"""Operators on texts and vectors beside brute force, and on odd tables."""

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from compare import connect, differences
import corpus_pipeline
from tessella.llm import brown, bytepair, graph, imatch, lines, minhash, mixing, neighbours, rangecoder, registry, substrings, text, tokenids, toxicity
from tessella.session import materialize

ODD = [
    (3, None, "b", 1), (5, "", "a", 2), (None, "some words of a row that has no id at all", "a", 3), (7, "same text twice here " * 12, None, 4),
    (7, "same text twice here " * 12, None, 4), (9, "Café déjà vu — don't STOP! <|endoftext|> ünïcode", "b", 5), (11, "x" * 30000 + " " + "ab " * 9000, "a", 6),
    (12, " \t\n ", "c", 7),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, source string, id long")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(registry.queries()[name](spark, sf_dir), connect(sf_dir), registry.oracle_sql()[name]) == ""


def test_token_files(spark, odd, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    core = Tokenizer.from_file(path)
    rows = tokenids.digest(tokenids.write(odd, path, tokenids.folder(spark))).collect()
    assert len(rows) == len(ODD)
    want = {i: core.encode(t or "", add_special_tokens=False).ids + [1] for i, t, *_ in ODD}
    for r in rows:
        ids = want[r["doc_id"]]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    in_order = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in in_order] == np.cumsum([0] + [r["n_tokens"] for r in in_order])[:-1].tolist()
    assert tokenids.digest(tokenids.write(empty, path, tokenids.folder(spark))).count() == 0


def test_words_have_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    core, own = Tokenizer.from_file(path), tokenids.WordTokens(path)
    rng = np.random.default_rng(6)
    bits = ["a", "Zé", "e\u0301", "<|endoftext|>", "<|startoftext|>", "'s", "\u3000", "\u00a0", "\x0b", "\n", " ", "  ", "12", "Σ", "ΑΣ", "İ", "한국", "\U0001f600", "-", "_", "\u0301", "\x01", "'", "a'S", "A", ",", "<|", "=\u0338"]
    texts = ["hello <|endoftext|> world", "x<|endoftext|>y", ""] + ["".join(rng.choice(bits, rng.integers(1, 12))) for _ in range(20000)]
    got = [own.encode(part, 1) for part in text.slices(pa.array(texts))]
    ids, count = (np.concatenate(c) for c in zip(*got))
    at = np.concatenate([[0], np.cumsum(count)])
    for k, e in enumerate(core.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == e.ids + [1], texts[k]


@pytest.mark.parametrize("n", [0, 1, rangecoder.BLOCK, 3 * rangecoder.BLOCK + 5])
def test_range_coder_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(0, 65535).astype(np.uint16)
    data = rangecoder.pack(np.zeros(1, rangecoder._DOC), ids)
    assert (rangecoder.unpack(data)[1] == ids).all()
    if n:
        bad = bytearray(data)
        bad[len(data) // 2] ^= 255
        with pytest.raises(ValueError):
            rangecoder.unpack(bytes(bad))


def test_range_coder_learns_and_confines_damage():
    rng = np.random.default_rng(3)
    phrases = [rng.integers(0, 40000, 12) for _ in range(40)]
    ids = np.concatenate([phrases[i] for i in rng.integers(0, 40, 700)]).astype(np.uint16)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    blocks = ids[: 4 * rangecoder.BLOCK].reshape(4, -1)
    freq = rangecoder.order0(ids)
    payloads = rangecoder.encode_blocks(blocks, freq)
    # payloads alone, as the header with its table of frequencies is of one size for few ids and many
    assert sum(map(len, payloads)) * 8 < 0.7 * blocks.size * -(share * np.log2(share)).sum()
    payloads[1] = bytes(255 - b for b in payloads[1])
    assert [(a == b).all() for a, b in zip(rangecoder.decode_blocks(payloads, freq), blocks)] == [True, False, True, True]


def test_byte_pairs(odd, empty):
    import tiktoken

    file = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
    core = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: core.encode_ordinary(t or "") for i, t, *_ in ODD}
    for leaf in (16, 8192):
        for r in bytepair.round_trip(odd, file, P.PATTERN, leaf=leaf).collect():
            assert r["ids_sha256"] == hashlib.sha256(np.array(want[r["doc_id"]], "<u4").tobytes()).hexdigest()
            text = next(t for i, t, *_ in ODD if i == r["doc_id"]) or ""
            assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bytepair.round_trip(empty, file, P.PATTERN).count() == 0


def test_neighbours_leave_bad_vectors_out(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [3.0]), (None, [1.0, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(v, v.where("vec_id % 100 = 0"), 10).collect()]
    assert sorted(got) == [(0, 1, 1, 0.0), (0, 2, 7, 2.0)]
    assert neighbours.nearest(v.limit(0), v.limit(0), 3).count() == 0


def test_repeated_queries_have_whole_lists(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 9.0]), *[(i, [float(i), 1.0]) for i in range(1, 9)]], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(v, v.where("vec_id = 0"), 3).collect()]
    assert sorted(got) == sorted([(0, 1, 1), (0, 2, 2), (0, 3, 3)] * 2)


def test_toxicity_separates_held_out_texts(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(list(rng.choice(words, 30)) + (["vile", "scum"] if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.train(df.where("doc_id < 300").select("doc_id", "text"), df.where("doc_id < 300").select("doc_id", "toxic"))
    got = toxicity.score(df.where("doc_id >= 300"), net).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in got]) > 0.95


def test_toxicity_of_odd_tables(odd, empty, spark):
    labels = spark.createDataFrame([(3, 1), (5, None), (7, 0), (None, 1)], "doc_id long, toxic int")
    for table in (odd, empty):
        out = toxicity.score(table, toxicity.train(table, labels)).collect()
        assert len(out) == table.count() and all(0 <= r["score"] <= 1 for r in out)


def test_components_agree(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    for found in (graph.connected_components(df), graph.contracted_components(df, 16), graph.contracted_components(df)):
        assert {r["id"]: r["component"] for r in found.collect()} == want


def test_crowds_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = [f"v{i}" for i in rng.integers(0, 10**6, 120)]
    rows = [(i, " ".join(base[:100] + [f"z{i}"] * 2 + base[100:])) for i in range(90)] + [(500, "one two three four five six"), (501, "other words are in this one here")]
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (0, i == 0) for i in range(90)) and got[500] == (500, True) and got[501] == (501, True)


def test_near_duplicates_of_odd_tables(odd, empty):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd).collect()]
    assert len(got) == len(ODD) and (3, 0, 3, True) in got and (5, 0, 5, True) in got and (12, 0, 12, True) in got
    assert [g for g in got if g[0] is None][0][2:] == (None, True)
    assert minhash.near_duplicates(empty).count() == 0


def test_repeats_of_odd_tables(odd, empty):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(odd).collect()}
    assert got[3] == got[5] == got[12] == (0, 0) and got[7] == (48, 48) and got[11] == (9001, 9000)
    assert substrings.remove_repeats(empty).count() == 0


def test_near_lines_go_and_others_stay(spark, odd, empty):
    line = "the quick brown fox jumps over the lazy dog while many people look on from afar today"
    rows = [(1, f"first own line\n{line}"), (2, f"{line.replace('lazy', 'lasy')}\n\nshort one"), (3, line.upper() + "!"), (4, "a wholly different sentence about the price of bread in town")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[4] == rows[3][1] and got[3] == "" and got[2] in ("\nshort one", rows[1][1])
    out = lines.dedup_lines(odd)
    assert set(odd.columns) < set(out.columns) and out.count() == len(ODD)
    assert lines.dedup_lines(empty).count() == 0


def test_lines_meet_all_lines_within_the_edits(spark, docs):
    rng = np.random.default_rng(5)
    own = {x for r in docs.where("text is not null").collect() for x in r["text"].split("\n") if x.count(" ") >= 5 and 60 < len(x) < 1000}
    rows = []
    for i, line in enumerate(sorted(own)[:150]):
        words = line.split(" ")
        for w in rng.choice(len(words), max(1, len(line) // 80), replace=False):  # one letter of each
            at = rng.integers(len(words[w])) if words[w] else 0
            words[w] = words[w][:at] + "q" + words[w][at + 1 :]
        rows += [(2 * i, line), (2 * i + 1, " ".join(words))]
    short = ["we all like red plums", "we all lyke red plums"]
    rows += [(1000, short[0]), (1001, short[1])]
    base = spark.createDataFrame(rows, "doc long, text string")
    gone = {r["doc"] for r in lines.duplicate_lines(base).collect()}
    want = base.select("doc", lines.normal_form("text").alias("line"))
    pairs = want.toDF("a", "line_a").crossJoin(want.toDF("b", "line_b")).where("a < b")
    near = pairs.where("levenshtein(line_a, line_b, cast(floor(greatest(length(line_a), length(line_b)) * 0.1) as int)) >= 0").select("a", "b").collect()
    assert len(near) >= 140 and {r["b"] for r in near} == gone


def test_short_and_spaceless_lines_go(spark):
    zh = "今天的天气非常好我们一起去公园散步然后在湖边的小餐馆里吃午饭下午再去图书馆看书晚上回家休息并且给远方的朋友写一封很长的信说说近况"
    rows = [
        (1, f"All rights reserved.\n\n---\nyes\n{zh}"), (2, f"all rights reserved\n\n---\nYes!\n{zh.replace('湖', '河')}"),
        (3, f"***\n{zh[:30]}\n \t\nyet"), (4, f"{zh[:12]}山{zh[13:30]}\n \t\n\u3000\n\u3000"),
    ]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "", 3: rows[2][1], 4: " \t\n\u3000\n\u3000"}


def test_lines_longer_than_a_lane(spark):
    words = [f"w{i % 700}" for i in range(1500)]
    rows = [(1, " ".join(words)), (2, " ".join(words) + " more"), (3, ", ".join(words))]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[2] == got[3] == ""


def test_long_lines_are_compared_as_a_whole(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(600)]
    other, at = list(words), {len(w): i for i, w in enumerate(words[:-1])}
    for n in (2, 3, 4, 5, 6):  # no kind of pieces has as many in both
        other[at[n]] += "q" * 8
    far = ["".join(rng.permutation(list(w))) if i % 3 else w for i, w in enumerate(words)]
    line, near, far = " ".join(words), " ".join(other), " ".join(words[:1] + far[1:])
    assert len(line) > lines.LONGEST
    rows = [(1, line), (2, near), (3, far)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: line, 2: "", 3: far}


def test_bounds_on_edits_lose_no_near_line(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(300):
        line = "".join(rng.choice(list(" aeéz山😀q"), rng.integers(10, 400)))
        other, left = list(line), len(line) // 11
        while left:
            p, c, kind = rng.integers(len(other)), str(rng.choice(list(" aeéz山😀q"))), rng.integers(3)
            other[p : p + int(kind != 1)] = [c] * int(kind != 2)
            left -= 1
        rows += [(i, line, "".join(other))]
    pairs = spark.createDataFrame(rows, "id int, line_a string, line_b string")
    sides = [pairs.select("id", F.length(c).alias("size"), *lines._counts(c)).alias(s) for c, s in (("line_a", "x"), ("line_b", "y"))]
    may = sides[0].join(sides[1], F.col("x.id") == F.col("y.id")).where(lines._may(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")))
    close = F.expr("levenshtein(line_a, line_b, cast(greatest(length(line_a), length(line_b)) div 10 as int)) >= 0")
    want = {r["id"] for r in pairs.where(close).select("id").collect()}
    assert len(want) > 250 and want <= {r["id"] for r in may.select("x.id").collect()}
    assert want <= {r["id"] for r in pairs.where(F.expr(lines._runs_allow())).select("id").collect()}


def test_lines_of_common_words_make_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(10)
    common = ["about", "because", "nothing", "whether", "without"]
    rows = [(i, " ".join(rng.permutation(common + ["".join(rng.choice(list("bcdfgklmpqvxyz"), 4)) for _ in range(6)]))) for i in range(200)]
    made, verify = [], lines.graph.link_blocks

    def counted(members, check, may):
        made.append(lines.graph._crossing(members.withColumn("component", F.col("id")), may).distinct().count())
        made.append(lines.graph._crossing(members.withColumn("component", F.col("id")), lambda a, b: F.lit(True)).distinct().count())
        return verify(members, check, may)

    monkeypatch.setattr(lines.graph, "link_blocks", counted)
    lines.duplicate_lines(spark.createDataFrame(rows, "doc long, text string")).count()
    assert made[0] * 5 < made[1]


def test_cheap_checks_say_what_whole_lines_say(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(400):
        words = ["".join(rng.choice(list("abcdeéz山"), rng.integers(1, 7))) for _ in range(rng.integers(1, 70))]
        if i % 4 == 0:
            words = list(rng.choice(words[:3], len(words)))  # the same words again and again
        other = list(words)
        for _ in range(rng.integers(0, 2 + len(words) // 8)):
            p, kind = rng.integers(len(other) + 1), rng.integers(3)
            other[p : p + int(kind != 1)] = ["".join(rng.choice(list("abcz"), 3))] * int(kind != 2)
        rows.append((i, " ".join(words), " ".join(other)))
    rows += [(400, "a b c d e f g h i j", "a b c d e f g h i j k"), (401, "one two three four five", "one two three four five s"), (402, "aaaaaaaaa b b b", "aaaaaaaaa b b")]
    pairs = spark.createDataFrame(rows, "id int, line_a string, line_b string")
    true = "levenshtein(line_a, line_b, cast(greatest(length(line_a), length(line_b)) div 10 as int)) >= 0"
    step = f"transform({lines._MIDDLE}, m -> {lines._in_step()})[0]"
    got = pairs.select(F.expr(true).alias("near"), F.expr(lines._SIMILAR).alias("similar"), F.expr(step).alias("step")).collect()
    assert all(r["near"] == r["similar"] and (r["near"] or not r["step"]) for r in got)
    assert 100 < sum(r["near"] for r in got) < 350 and sum(r["step"] for r in got) > 60


def test_the_loop_over_pairs_is_short_enough_to_be_compiled(spark):
    line = spark.range(9).select("id", F.lit(1).alias("block"), F.lit("some line").alias("line")).withColumn("size", F.length("line"))
    members = line.select("block", "id", "size", *lines._counts("line"))
    members = materialize(members).withColumn("component", F.col("id"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # plans are made at once
    plans = graph._crossing(members.hint("merge"), lines._may)._jdf.queryExecution().debug().codegenToSeq()
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [plans.apply(i)._3().maxMethodCodeSize() for i in range(plans.size())]
    assert sizes and max(sizes) < 8000  # the JVM interprets longer ones


def test_no_pair_of_a_larger_block_is_verified_twice(spark):
    members = spark.range(60).crossJoin(spark.range(3).toDF("block")).select("block", "id")
    seen = []

    def verify(pairs):
        seen.extend((r["a"], r["b"]) for r in pairs.collect())
        return pairs.where("a + 1 = b and b < 4")

    got = graph.link_blocks(members, verify, lambda a, b: F.lit(True)).collect()
    linked = {(a, b) for a in range(4) for b in range(4)}
    assert {(r["id"], r["component"]) for r in got} == {(i, 0) for i in range(4)}
    assert len(seen) == len(set(seen)) and {(a, b) for a in range(60) for b in range(a + 1, 60)} - set(seen) <= linked


def test_mix_meets_targets(docs, odd, empty):
    rows = mixing.mix(docs).collect()
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1 and all(r["taken"] <= 2 * r["size"] for r in own)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(empty).count() == 0


def test_class_bigrams_beat_unigrams_on_held_out_texts(docs, odd, empty):
    rows = [r for r in brown.score(docs, held_out=registry.crc_remainder("doc_id", 5) == 1).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert brown.score(odd).count() == len(ODD) and brown.score(empty).count() == 0


def test_words_beyond_the_core_have_classes_of_their_context(spark):
    rng = np.random.default_rng(2)
    # nouns and verbs take turns, and their last letters say nothing
    texts = [" ".join(f"{'nv'[i % 2]}{int(400 * rng.random() ** 2)}x" for i in range(60)) for _ in range(400)]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    model = brown.fit(train, brown.word_counts(train), 40)
    nouns = spark.createDataFrame([(" ".join(f"n{i}x" for i in range(400)),)], "text string")
    is_noun = np.isin(model.listed, brown.word_counts(nouns).toArrow().column("word").to_numpy().view(np.uint64))
    group = model.group[: len(model.listed)]
    assert len(model.listed) > 700
    kinds = [np.bincount(group[is_noun], minlength=group.max() + 1), np.bincount(group[~is_noun], minlength=group.max() + 1)]
    assert np.minimum(*kinds).sum() < 0.05 * len(group)


def test_fingerprints(docs, odd, empty):
    rows = sorted(docs.select("doc_id", "text").collect())
    got = sorted(imatch.edited_report(docs).collect())
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    for k, r in enumerate(got):
        text, after = rows[k][1] or "", rows[(k + 1) % len(rows)][1] or ""
        edit = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert r["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest() and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert np.mean([r["near_edited"] for r in got]) > np.mean([r["near_next"] for r in got])
    assert imatch.edited_report(odd).count() == len(ODD) and imatch.edited_report(empty).count() == 0


def test_sequential_test_keeps_similar_signatures():
    a = np.arange(125, dtype=np.uint32)[None]
    b = a.copy()
    b[0, ::10] += 1000
    assert minhash.plausible(a, b, 0.85).tolist() == [True] and minhash.plausible(a, a + 500, 0.85).tolist() == [False]


def test_winnowed_minimum():
    x = np.random.default_rng(0).integers(0, 9, 50)
    assert substrings.sliding_first_min(x, 7).tolist() == [i + int(np.argmin(x[i : i + 7])) for i in range(44)]


def test_arrow_slices_take_whole_texts():
    from tessella.llm.text import slices

    parts = list(slices(pa.array(["abc", None, "d" * 50, ""]), 10))
    assert [(p.first, p.last) for p in parts] == [(0, 2), (2, 3), (3, 4)] or sum(p.last - p.first for p in parts) == 4


def test_pipeline_decodes_what_it_encodes(spark, monkeypatch):
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        coder = bytepair.BytePairs(f.read(), P.PATTERN)
    ids = coder.checked("Café one two")
    coder.bytes_of[ids[-1]] = b"?"
    with pytest.raises(ValueError, match="decoded ids are not"):
        coder.checked("Café one two")
    asked, real = [], bytepair.encode
    monkeypatch.setattr(bytepair, "encode", lambda *a, **k: asked.append(k) or real(*a, **k))
    docs = spark.createDataFrame([(1, "a", "one two"), (2, None, None), (None, "a", "Café")], "doc_id long, source string, text string")
    assert len(corpus_pipeline.encode(spark, docs, "").collect()) == 3 and asked == [{"checked": True}]


def test_pipeline_keeps_one_of_repeated_rows(spark):
    text = "some words of a text that is longer than one shingle of five words"
    rows = [(1, text), (1, text), (2, text), (3, "another text of other words that nobody else has"), (None, text), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(got, key=repr) == [1, 3, None, None]


CLASHING = ["_row", "row", "kept_id", "toxicity", "taken", "size", "doc", "removed", "lines", "copy", "first", "n_lines", "id"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_pipeline_stages_take_odd_tables(spark, tmp_path, odd, name, stage):
    labels = spark.createDataFrame([(3, 1), (5, None), (7, 0), (None, 1)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    plain = odd.selectExpr("doc_id", "text", "cast(null as string) lang", "source", "cast(length(text) as bigint) n_chars")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    wide = docs.selectExpr("*", *[f"'{c}' as `{c}`" for c in CLASHING])
    for table in (docs, wide, docs.limit(0)):
        out = stage(spark, table, str(tmp_path))
        rows = out.collect()
        if stage is not corpus_pipeline.encode:
            assert out.columns == table.columns
        if stage in (corpus_pipeline.dedup_lines, corpus_pipeline.encode):
            assert len(rows) == table.count()
        if stage is corpus_pipeline.near_dedup:
            assert len(rows) in (0, len(ODD) - 1)
        assert all(r[c] == c for r in rows for c in CLASHING if c in out.columns)


def test_pipeline_mixes_every_row(spark):
    rows = [(None, "a", "one two three"), (None, "a", "four five"), (4, "a", "six seven eight"), (4, "a", "six seven eight"), (5, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = [r["text"].split(" ") for r in corpus_pipeline.mix(spark, docs, "").collect()]
    assert sum(map(len, got)) == 17  # 1.5 times 11 words, rounded
    assert {w for t in got for w in t} == set("one two three four five six seven eight".split(" "))
