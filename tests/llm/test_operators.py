import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from comparing import rows_of, rows_of_sql

from ephemera.llm import forest, matroska, ppm, queries, ring, seeds, store, subword, suffixes, templates, viterbi
from ephemera.llm.common import string_parts

WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 1 line dedup


def test_lines_equal_their_twin(spark, duck, sf):
    assert rows_of(queries.op1_line_dedup(spark, sf)) == rows_of_sql(duck, templates.SQL)


def test_lines_generalise_and_keep_the_first(spark):
    rows = [(i, f"intro {i} of its own kind\nuser {name} logged in from the office at noon on day {i}\n12 34\nend {i}x") for i, name in enumerate(["ann", "bob", "cy", "dee"])]
    out = {r["doc_id"]: r["text"].split("\n") for r in templates.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # names on the path keep lines apart; a line of digits is its own template, so that its repeats go
    assert all(v[i == 0].startswith("user") for i, v in out.items()) and out[0] == ["intro 0 of its own kind", "user ann logged in from the office at noon on day 0", "12 34", "end 0x"]
    assert all(len(out[i]) == 1 for i in (1, 2, 3))
    rows = [(i, f"the user has {name} logged in from the office at noon on day {i}") for i, name in enumerate(["ann", "bob", "cy", "dee"])]
    out = {r["doc_id"]: r["n_dropped"] for r in templates.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {0: 0, 1: 1, 2: 1, 3: 1}


def test_a_leaf_holds_several_families_and_unrelated_lines(spark):
    rng = random.Random(2)
    word = lambda: f"w{''.join(rng.choice('abcdefghij') for _ in range(6))}"
    rows, n = [], 12
    for i in range(n):
        rows.append((i, f"the user has {word()} logged in from {word()} at noon on {word()}"))
        rows.append((100 + i, f"the user has {word()} been sent a bill of {word()} for march"))
        rows += [(1000 + 40 * i + j, f"the user has {' '.join(word() for _ in range(9))}") for j in range(40)]
        # common words at some places are no family
        rows += [(5000 + 40 * i + j, f"the user has {' '.join(rng.choice(['of', 'in', word(), word()]) for _ in range(9))}") for j in range(40)]
    out = {r["doc_id"]: r["n_dropped"] for r in templates.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i] for i in range(n)] == [0, *[1] * (n - 1)] and [out[100 + i] for i in range(n)] == [0, *[1] * (n - 1)]
    assert not any(v for k, v in out.items() if k >= 1000)


def test_passages_recur_in_two_documents_and_digits_within_tokens(spark):
    passage = " ".join(f"word{'abcdefgh'[i % 8]}{'klmnopqr'[i // 8]}" for i in range(60))
    rows = [(1, passage + "\nshort line of five words"), (2, "other\n" + passage), (3, "short line of five words")]
    rows += [(10 + i, f"日本語の文章{i}年です。\n3.5\n{i}.{i + 1}") for i in range(4)]
    out = {r["doc_id"]: r["text"] for r in templates.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == rows[0][1] and out[2] == "other" and out[3] == rows[2][1]
    # a family of lines without spaces; figures alone are told apart by their digits
    assert out[10] == rows[3][1] and [out[i] for i in (11, 12, 13)] == ["1.2", "2.3", "3.4"]


def test_lines_odd_rows(spark, odd, none):
    out = templates.dedup_lines(spark, odd)
    assert out.count() == odd.count() and out.columns[: len(odd.columns) - 1] == [c for c in odd.columns if c != "n_lines"]
    assert all(r["n_lines"] == 0 and r["n_dropped"] == 0 for r in out.where("text IS NULL").collect())
    assert templates.dedup_lines(spark, none).count() == 0


# 2 token store


def test_store_equals_the_library(spark, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for ident, text in texts(odd):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want[ident, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    out = store.tokenised(spark, odd, WORD_BPE).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == want and all(r["verified"] for r in out)
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(out, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert ids == sorted(ids)
    assert store.tokenised(spark, none, WORD_BPE).count() == 0


def test_store_encodes_odd_words_like_the_library():
    own = store.Encoder(WORD_BPE)
    for w in ["It's", "O'Neil's.", "a<|endoftext|>", "Ünï.", "İstanbul,", "ΣΑΣ.", "x1y2.", "don't!!", "é.", "́a", "日本語。", "K.", "A\x1cB", "a b", "", "½.", " 's", "he 's'd"]:
        assert own.tokenizer.encode(w, add_special_tokens=False).ids == own.ids([w])[0].tolist(), w


def test_store_encodes_like_the_library_whatever_stands_together(spark):
    """Letters that change when lowered or composed, marks, special tokens, punctuation and white space, at random."""
    own, rng = store.Encoder(WORD_BPE), random.Random(5)
    bits = [*"aBzéÉßẞİıΣσςǅﬁÅÅ각日本ñÑøÀÿ×÷\u0307\u0301\u200d\u00a0\u2028\u0085\x1c\x0b", *".,;:!?*#&%$|'\"-_()/", *"0189½²", " ", "\n", "\t", "\r", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "BELEDİYESİ.", "GAZETESİ:", "e\u0301.", "n\u0303,", "ÜBER!"]
    cut = ["".join(rng.choices(bits, k=rng.randrange(1, 9))) for _ in range(20_000)]
    for t, ids in zip(cut, own.ids(cut), strict=True):
        assert own.tokenizer.encode(t, add_special_tokens=False).ids == ids.tolist(), t
    rows = [(1, "BELEDİYESİ. sonra"), (2, "next")]
    out = {r["doc_id"]: r for r in store.tokenised(spark, spark.createDataFrame(rows, "doc_id long, text string"), WORD_BPE).collect()}
    assert out[2]["start"] == out[1]["n_tokens"] == len(own.tokenizer.encode(rows[0][1], add_special_tokens=False).ids) + 1


def test_store_keeps_each_chunk_once(spark):
    rng = np.random.default_rng(1)
    shared = " ".join(map(str, rng.integers(0, 999, 6000)))
    docs = spark.createDataFrame([(i, f"start {i} " + shared) for i in range(5)], "doc_id long, text string")
    chunks, recipes, _ = store.write_store(spark, docs, WORD_BPE)
    assert chunks.count() == chunks.select("chunk").distinct().count() < recipes.count() / 3
    bad = chunks.withColumn("payload", chunks["payload"]).limit(1).collect()[0]
    assert store.address(__import__("zstandard").decompress(bad["payload"])) == bad["chunk"]


def test_merkle_root_changes_with_any_leaf():
    leaves = [bytes([i]) * 16 for i in range(5)]
    assert len({store.merkle_root(leaves[:i] + [b"x" * 16] + leaves[i + 1 :]) for i in range(5)} | {store.merkle_root(leaves)}) == 6


# 3 decontamination


def plain_leaks(docs, items):
    """All alignments of all pairs, whether a mask sees them or not."""
    out = Counter()
    for ident, text in docs:
        d = WORD.findall((text or "").translate(LOWER))
        for item, t in set(items):
            b = WORD.findall((t or "").translate(LOWER))
            n, best = len(b), None
            least = max(-(-6 * n // 10), min(n, 7))
            for at in range(1 - n, len(d)) if n >= 5 else ():
                same = [0 <= at + i < len(d) and d[at + i] == w for i, w in enumerate(b)]
                if sum(same) >= least and (best is None or sum(same) > best[0]):
                    best = sum(same), at
            if best and ident is not None:
                out[ident, item, best[1], best[0], n] += 1
    return out


def test_no_alignment_that_counts_is_hidden_from_the_masks():
    """The most tokens that can agree while every mask misses, for each length, by states of the last tokens."""
    wide = max(map(len, seeds.MASKS)) - 1
    masks = [int(m, 2) for m in seeds.MASKS]
    most = {0: 0}
    for n in range(1, 301):
        longer = {}
        for state, count in most.items():
            for agrees in (0, 1):
                now = state << 1 | agrees
                if not any(now & m == m for m in masks):
                    now &= (1 << wide) - 1
                    longer[now] = max(longer.get(now, 0), count + agrees)
        most = longer
        assert n < seeds.SHORTEST or max(most.values()) < seeds.needed(n), n


def test_leaks_equal_brute_force(spark, odd, none):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice(["red", "blue", "Green", "tall", "low", "far"]) + str(rng.randrange(40)) for _ in range(n))) for i, n in enumerate([60, 30, 20, 15, 12, 11, 10, 8, 7, 6, 5, 4, 0])]
    docs = []
    for i, t in items[:-2]:
        w = t.split()
        docs.append((100 + i, "before it " + t + " and after"))
        docs.append((300 + i, " ".join(w[: len(w) * 2 // 3])))
        for k in range(40):
            changed = list(w)
            for j in rng.sample(range(len(w)), rng.choice([len(w) * 4 // 10, len(w) * 3 // 10, len(w) // 2, 1])):
                changed[j] = f"new{rng.randrange(99)}"
            docs.append((1000 * (i + 1) + k, f"so {k} then " + " ".join(changed) + rng.choice(["", " end"])))
    docs += [(400, None), (401, ""), (402, items[0][1][:60]), (100, docs[0][1]), (None, items[0][1])]
    items += [items[1], (50, items[3][1]), (51, None), (None, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = seeds.leaks(spark, spark.createDataFrame(docs, "doc_id long, text string"), bench)
    want = plain_leaks(docs, [i for i in items if i[0] is not None])
    assert Counter(tuple(r) for r in out.collect()) == want and len(want) > 200
    assert {r["item_id"] for r in seeds.refused(bench).collect()} == {None, 11, 12, 51}
    assert seeds.leaks(spark, odd, bench).count() == 0
    assert seeds.leaks(spark, none, bench).count() == seeds.leaks(spark, odd, bench.limit(0)).count() == 0


def test_leaks_with_words_put_in_and_excerpts(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(1 << 40)}" for _ in range(n)]
    item, phrase = fresh(59), fresh(16)
    items = [(1, " ".join(item)), (2, " ".join(phrase * 4))]
    docs = [
        (10, [*fresh(9), *item[:20], "new", *item[20:40], "new", *item[40:], *fresh(9)]),
        (11, [*fresh(9), *item[:20], *item[21:40], *item[41:], *fresh(9)]),
        (12, [*fresh(9), *item[30:], *fresh(9)]),
        (13, [*fresh(9), *item[:19], *fresh(9)]),
        (14, [*fresh(9), *phrase, *fresh(9)]),
        (15, [*item[:15], *fresh(200), *item[15:30]]),
    ]
    out = seeds.leaks(spark, spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    # 14 has a quarter of its item, 15 two short parts that lie far apart
    assert sorted(tuple(r) for r in out.collect()) == [(10, 1, 9, 59, 59), (11, 1, 9, 57, 59), (12, 1, -21, 29, 59)]


# 4 SentencePiece


def as_unigram():
    """The public model with the library's unigram search over the same pieces and scores."""
    import sentencepiece

    def varint(b, i):
        n = s = 0
        while True:
            n |= (b[i] & 127) << s
            s, i = s + 7, i + 1
            if b[i - 1] < 128:
                return n, i

    def fields(b):
        i = 0
        while i < len(b):
            first = i
            tag, i = varint(b, i)
            if tag & 7 == 0:
                _, i = varint(b, i)
                body = b""
            else:
                n, i = varint(b, i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
                body, i = b[i : i + n], i + n
            yield tag >> 3, body, b[first:i]

    def count(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + count(n >> 7)

    out = b""
    for field, body, whole in fields(open(PIECES, "rb").read()):
        if field == 2:
            body = b"".join(b"\x18\x01" if f == 3 else w for f, _, w in fields(body))
            whole = b"\x12" + count(len(body)) + body
        out += whole
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_viterbi_equals_the_library(spark, sf):
    """Pieces of raw texts as they stand, and with indentation, tabs and runs of spaces put in."""
    library, own = as_unigram(), viterbi.Encoder(viterbi.vocabulary(PIECES))
    rng = random.Random(2)

    def scored(ids):
        low = [library.is_byte(i) or library.get_score(i) < -1e8 for i in ids]
        return sum(low), sum(library.get_score(i) for i, below in zip(ids, low, strict=True) if not below)

    cut = ["a    b", "  lead", "\tx  y", "   ", "a  ", "def f(x):\n    return  x\n" + " " * 37 + "y", "\n\n  \t "]
    for (text,) in spark.read.parquet(f"{sf}/documents.parquet").select("text").where("text IS NOT NULL").limit(150).collect():
        k = rng.randrange(max(1, len(text) - 60))
        part = text[k : k + 60]
        cut += [part, part.replace(". ", ".   ").replace("\n", "\n    ").replace(", ", ",\t"), "  " + part]
    for part in filter(None, cut):
        # of paths with equal scores the library may take another; its sums are 32-bit floats, whose steps are 64
        # from a lone mark, a run or an unknown character on, so that it may then miss the best path by some steps
        ids = own.ids([part])[0].tolist()
        mine, best = scored(ids), scored(library.nbest_encode(part, nbest_size=2)[0])
        assert library.decode(ids) == part and mine[0] == best[0], part
        assert mine[1] == best[1] if not mine[0] else 0 <= mine[1] - best[1] <= 64 * (1 + mine[0]), part


def plain_viterbi(vocab, text):
    best = [(0, [])] + [None] * len(text)
    for i in range(1, len(text) + 1):
        for n in range(min(i, vocab.longest), 0, -1):
            piece = vocab.pieces.get(text[i - n : i])
            if piece is None and n == 1 and best[i] is None:
                piece = None, vocab.unknown
            if piece and (best[i] is None or best[i - n][0] + piece[1] > best[i][0]):
                best[i] = best[i - n][0] + piece[1], best[i - n][1] + ([piece[0]] if piece[0] is not None else [vocab.byte_ids[b] for b in text[i - 1].encode()])
    return best[-1][1]


def test_stream_commits_what_a_whole_search_finds():
    vocab, rng = viterbi.vocabulary(PIECES), random.Random(4)
    for _ in range(40):
        text = "".join(rng.choice("theingouréß日 \n😀"[: rng.choice([6, 15])]) for _ in range(rng.randrange(300))).replace(" ", "▁")
        stream = viterbi.Stream(vocab)
        ids = [i for k in range(0, len(text), 7) for i in stream.feed(text[k : k + 7])] + stream.close()
        assert ids == plain_viterbi(vocab, text)
    stream = viterbi.Stream(vocab)
    for _ in range(200):
        stream.feed("the" * 50)
    assert stream.widest <= 4 * vocab.longest


def test_stretches_meet_at_spaces():
    """A stretch by stretch search finds what one search over the whole text finds."""
    vocab, rng = viterbi.vocabulary(PIECES), random.Random(6)
    own = viterbi.Encoder(vocab)
    for _ in range(200):
        text = "".join(rng.choice("theingou  \n\té日") for _ in range(rng.randrange(1, 120)))
        assert own.ids([text])[0].tolist() == plain_viterbi(vocab, (" " + text).replace(" ", "▁"))


def test_encoding_round_trip(spark, odd, none):
    out = viterbi.encode(odd, PIECES)
    assert out.count() == odd.count() and out.where("NOT lossless").count() == 0
    back = viterbi.decode(out, PIECES)
    assert back.where("decoded <> coalesce(text, '')").count() == 0 and back.where("text IS NULL AND n_ids <> 0").count() == 0
    own = viterbi.Encoder(viterbi.vocabulary(PIECES))
    for t in ["a▁b ▁", " lead", "trail ", "x" * 100 + "▁y"]:
        assert own.text(own.ids([t])[0].tolist()) == t
    assert viterbi.encode(none, PIECES).count() == 0


# 5 sharding


def test_shards_are_even_and_gapless(spark, odd, none):
    for shards in (16, 3, 1):
        out = ring.shard(spark, odd, shards=shards).collect()
        assert len(out) == odd.count()
        slots = defaultdict(list)
        for r in out:
            slots[r["shard"]].append(r["slot"])
        sizes = [len(slots[s]) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts(odd))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    assert ring.shard(spark, none).count() == 0


def test_one_hot_key_and_bounded_loads(spark):
    df = spark.range(30000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS doc_id", "'same' AS text")
    out = ring.shard(spark, df, shards=5).groupBy("shard").count().collect()
    assert {r["count"] for r in out} == {6000}
    loose = ring.shard(spark, spark.range(20000).selectExpr("id AS doc_id", "'t' AS text"), shards=8, slack=0.1).groupBy("shard").count().collect()
    assert max(r["count"] for r in loose) <= 2750 and sum(r["count"] for r in loose) == 20000


def test_growing_moves_little():
    counts = dict.fromkeys(range(0, 1 << 16, 2), 3)

    def owners(n, slack):
        return {(c, r): s for c, a, b, s, _ in ring.placements(counts, n, 64, slack) for r in range(a, b)}

    a, b = owners(16, 0.25), owners(17, 0.25)
    assert sum(a[k] != b[k] for k in a) < 0.2 * len(a)


# 6 near duplicates


def plain_components(docs):
    sets = defaultdict(set)
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    docs = []
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randrange(4, 200))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append((len(docs), " ".join(w)))
    docs += [(len(docs) + i, t) for i, t in enumerate([None, "", "  \n", "one two", "One  two", "three", docs[3][1]])]
    out = forest.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect()} == plain_components(docs)


def test_a_dense_group_is_one_component(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    docs = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(150)] = f"x{i}"
        docs.append((i, " ".join(w)))
    out = forest.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"))
    assert out.where("component_id <> 0").count() == 0


def test_pairs_within_a_crowd_are_found(spark):
    """Every document shares a long passage with all others, below the threshold; pairs within that crowd lie just above it."""
    rng = random.Random(3)
    passage, docs = [f"p{i}" for i in range(170)], []
    for _ in range(400):
        own = [f"o{rng.randrange(1 << 40)}" for _ in range(13)]
        for _ in range(2):
            docs.append((len(docs), " ".join([*passage, *own, *(f"t{rng.randrange(1 << 40)}" for _ in range(27))])))
    out = forest.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect()} == plain_components(docs)
    assert out.where("kept").count() == 400


def test_pairs_at_the_threshold_within_a_crowd_just_under_it(spark):
    """Similarity 0.725 within the crowd, 0.75 in its pairs, ids shuffled: a pair is told from the rest by two shingles."""
    rng = random.Random(7)
    passage, ids, docs = [f"p{i}" for i in range(104)], list(range(3000)), []
    rng.shuffle(ids)
    for k in range(1500):
        both = [f"o{k}", f"q{k}"]
        docs += [(ids[2 * k + j], " ".join([*passage, *both, *(f"t{rng.randrange(1 << 40)}" for _ in range(17))])) for j in range(2)]
    assert plain_components(docs[:200]) == {i: (119, min(pair), i == min(pair)) for k in range(100) for pair in [ids[2 * k : 2 * k + 2]] for i in pair}
    out = forest.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {i: min(pair) for k in range(1500) for pair in [ids[2 * k : 2 * k + 2]] for i in pair}


def test_a_region_that_is_looked_at_in_parts_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(forest, "RUN", 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    rng = random.Random(13)
    passage, docs = [f"p{i}" for i in range(104)], []
    for k in range(150):
        docs += [(2 * k + j, " ".join([*passage, f"o{k}", f"q{k}", *(f"t{rng.randrange(1 << 40)}" for _ in range(17))])) for j in range(2)]
    out = forest.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["doc_id"]: r["component_id"] for r in out} == {i: i - i % 2 for i in range(300)}


def test_different_texts_of_one_id(spark):
    rng = random.Random(14)
    a, b = ([f"w{rng.randrange(1 << 30)}" for _ in range(60)] for _ in range(2))
    rows = [(5, " ".join(a)), (5, " ".join(b)), (5, " ".join(b)), (9, " ".join(a)), (10, " ".join(b)), (11, " ".join([*a, "more"])), (12, " ".join([*b, "more"]))]
    runs = [sorted(map(tuple, forest.near_duplicates(spark, spark.createDataFrame(order, "doc_id long, text string")).collect())) for order in (rows, rows[::-1])]
    assert runs[0] == runs[1]
    got = {i: c for i, _, c, _ in runs[0]}
    assert got[5] == got[9] == got[10] == got[11] == got[12] == 5


def test_a_class_headed_by_an_id_with_several_texts_is_searched(spark):
    """Id 5 heads the classes of all its texts; 9 and 12 have one text each, and are near."""
    rng = random.Random(21)
    for _ in range(3):
        own = [[f"w{rng.randrange(1 << 30)}" for _ in range(60)] for _ in range(4)]
        rows = [(5, " ".join(w)) for w in own] + [x for k, w in enumerate(own) for x in ((9 + 10 * k, " ".join(w)), (12 + 10 * k, " ".join([*w, "more"])))]
        # 100 has two sets of its own, neither equal to another's, and so joins 200 and 300
        two = [[f"v{rng.randrange(1 << 30)}" for _ in range(60)] for _ in range(2)]
        rows += [(100, " ".join(two[0])), (100, " ".join(two[1])), (200, " ".join([*two[0], "x"])), (300, " ".join([*two[1], "x"])), (400, " ".join(two[1]))]
        got = {r["doc_id"]: r["component_id"] for r in forest.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {i: 5 if i < 100 else 100 for i, _ in rows}


def test_an_id_with_a_third_of_all_rows_and_many_texts(spark):
    rng = random.Random(22)
    texts_ = [" ".join(f"w{rng.randrange(1 << 30)}" for _ in range(30)) for _ in range(300)]
    rows = [(7, t) for t in texts_] + [(1000 + i, t + " more") for i, t in enumerate(texts_)] + [(5000 + i, " ".join(f"u{rng.randrange(1 << 30)}" for _ in range(30))) for i in range(300)]
    got = {r["doc_id"]: r["component_id"] for r in forest.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 7 if i < 5000 else i for i, _ in rows}


def test_integer_ids(spark):
    docs = spark.createDataFrame([(1, "some text of a few words", "en"), (2, None, None)], "doc_id int, text string, lang string")
    assert [r["doc_id"] for r in ppm.identify(spark, docs).collect()] == [1, 2] and matroska.digests(spark, docs).count() == 2


def test_near_duplicates_odd_rows(spark, odd, none):
    out = forest.near_duplicates(spark, odd)
    assert out.count() == odd.count()
    assert all(r["component_id"] is None and r["kept"] for r in out.where("doc_id IS NULL").collect())
    got = {r["doc_id"]: r["component_id"] for r in out.collect()}
    assert got[6] == got[7] == 0 and got[8] == 1 and got[14] == 13 and got[10] == 10
    assert forest.near_duplicates(spark, none).count() == 0


# 7 suffix sorting


def plain_repeats(docs, n=suffixes.LENGTH):
    data = [(i, (t or "").encode()) for i, t in docs]
    count = Counter(b[p : p + n] for _, b in data for p in range(len(b) - n + 1))
    out = Counter()
    for i, b in data:
        mark = np.zeros(len(b) + 1, int)
        for p in range(len(b) - n + 1):
            if count[b[p : p + n]] > 1:
                mark[p] += 1
                if p + n < len(mark):
                    mark[p + n] -= 1
        gone = np.cumsum(mark)[: len(b)] > 0
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i, len(b), int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(int)) == 1)), hashlib.sha256(left).hexdigest()] += 1
    return out


def test_removal_equals_brute_force(spark, odd, none):
    rng = random.Random(8)
    piece = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    a, b = piece(450), piece(199)
    docs = [(i, piece(rng.randrange(300)) + rng.choice([a, a[100:320], b, a[:205], "ab" * 250]) + piece(rng.randrange(300)) + rng.choice(["", a, b])) for i in range(40)] + [(99, None), (98, "")]
    for df, rows in ((spark.createDataFrame(docs, "doc_id long, text string"), docs), (odd, texts(odd))):
        out = suffixes.remove_repeats(spark, df).drop("kept").collect()
        assert Counter(tuple(r) for r in out) == plain_repeats(rows)
    assert suffixes.remove_repeats(spark, none).count() == 0


def test_a_crowd_goes_by_hashes(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CROWD", 3)
    rng = random.Random(6)
    piece = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    a = piece(300)
    docs = [(i, piece(100 + i) + a + piece(90)) for i in range(12)]
    out = suffixes.remove_repeats(spark, spark.createDataFrame(docs, "doc_id long, text string")).drop("kept").collect()
    assert Counter(tuple(r) for r in out) == plain_repeats(docs)


def test_deep_shallow_sorts_suffixes():
    rng = np.random.default_rng(1)
    for trial in range(20):
        d = rng.integers(97, 99 + trial % 3, 300, dtype=np.uint8)
        d = np.concatenate([d, d[50:280], d[::-1], d[50:290]])
        words, starts, b = suffixes.words_at(d), np.arange(len(d)), d.tobytes()
        for limit in (13, 40, 200):
            order = suffixes.deep_shallow(words, starts, np.zeros(len(d), int), limit)
            cut = [(b[i : i + limit] + b"\0" * limit)[:limit] for i in range(len(b))]
            assert [cut[i] for i in order] == sorted(cut)


# 8 Matroska


@pytest.mark.parametrize("n", [0, 1, 63, 64, 511, 512, 513, 4096, 5000, 131072, 131073, 400001])
def test_media_round_trip(n):
    payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    media = matroska.parse_media(data := matroska.write_media(payload))
    assert b"".join(data[p.offset : p.offset + p.length] for p in media.packets) == payload
    times = [p.timestamp_ns for p in media.packets]
    assert times == sorted(times) and media.tracks == {1: "A_PCM/INT/LIT"}
    for time, track, at in media.cues:
        assert matroska.vint(data, at, True)[0] == matroska.CLUSTER and track == 1 and time in times


def test_all_lacing_and_bad_files():
    frames = [b"a" * 300, b"bb", b"c" * 255, b"dddd"]
    xiph = bytes([0x81, 0, 0, 0x02, 3]) + bytes([255, 45, 2, 255, 0]) + b"".join(frames)
    assert [xiph[o : o + n] for o, n in matroska.block_frames(xiph, 0, len(xiph))[3]] == frames
    for group in (frames, [b"x" * 7] * 3, [b"one"]):
        flag, body = matroska.laced(group)
        block = bytes([0x81, 0, 5, flag]) + body
        track, time, _, got = matroska.block_frames(block, 0, len(block))
        assert (track, time) == (1, 5) and [block[o : o + n] for o, n in got] == group
    whole = matroska.write_media(b"abc" * 50)
    with pytest.raises(ValueError):
        matroska.parse_media(whole[:-3])
    with pytest.raises(ValueError):
        matroska.parse_media(b"\x00" * 9)


def plain_features(text):
    p = matroska.payload_of(text)
    x = [b - 128 for b in p]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
    return f"tracks=1;packets={-(-len(p) // 512)};clusters={-(-len(p) // 131072)};ms={len(p) / 8:.3f};energy={sum(v * v for v in x)};peak={max(map(abs, x))};crossings={crossings}"


def test_unknown_sizes_and_timestamps():
    """Clusters and the segment as a live stream writes them, without sizes, and frames of a lace in turn."""
    payload = np.random.default_rng(5).integers(0, 256, 400_001, dtype=np.uint8).tobytes()
    data = matroska.write_media(payload)
    head = next(e for e in matroska.elements(data, 0, len(data)) if e[0] == matroska.SEGMENT)
    live = bytearray(data[: head[1]][: data.index(b"\x18\x53\x80\x67") + 4] + b"\x01" + b"\xff" * 7)
    for ident, a, b in matroska.elements(data, head[1], head[2]):
        live += ident.to_bytes(4, "big") + b"\xff" + data[a:b] if ident == matroska.CLUSTER else matroska.element(ident, data[a:b])
    live = bytes(live)
    media, whole = matroska.parse_media(live), matroska.parse_media(data)
    assert b"".join(live[p.offset : p.offset + p.length] for p in media.packets) == payload
    assert [(p.timestamp_ns, p.cluster) for p in media.packets] == [(p.timestamp_ns, p.cluster) for p in whole.packets]
    assert [p.timestamp_ns for p in whole.packets] == [64_000_000 * i for i in range(len(whole.packets))]


def test_bad_files_have_an_error_each(spark):
    whole, rng = matroska.write_media(b"abc" * 5000), random.Random(4)
    files = [whole, whole[:700], b"\x00" * 9, None] + [bytes(b ^ (rng.randrange(256) if rng.random() < 0.01 else 0) for b in whole) for _ in range(60)] + [whole[: rng.randrange(len(whole))] for _ in range(40)]
    for f in filter(None, files):
        try:
            matroska.parse_media(f)
        except ValueError:
            pass
    df = spark.createDataFrame([(i, 1, f) for i, f in enumerate(files)], "doc_id long, n_bytes long, media binary")
    out = {r["doc_id"]: r for r in matroska.digest_files(df).collect()}
    assert len(out) == len(files) and out[0]["error"] is None and out[0]["payload_bytes"] == 15000 and out[1]["error"] and out[1]["feature"] is None
    rows = matroska.packets(df).collect()
    assert sum(r["doc_id"] == 0 for r in rows) == 30 and [r["error"] is not None for r in rows if r["doc_id"] == 1] == [True] and not any(r["doc_id"] == 3 for r in rows)


def test_media_of_odd_rows(spark, odd, none):
    out = matroska.digests(spark, odd).collect()
    want = Counter()
    for i, t in texts(odd):
        p = matroska.payload_of(t)
        assert len(p) % 64 == 0 and len(p) >= 64 and p.startswith((t or "").encode())
        media = matroska.write_media(p)
        want[i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest(), plain_features(t), None] += 1
    assert Counter(map(tuple, out)) == want
    assert matroska.packets(matroska.store(spark, odd)).count() > odd.count() and matroska.digests(spark, none).count() == 0


# 9 quality


def test_quality_on_held_out_rows(spark, sf):
    out = queries.op9_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r for r in out if r["quality"] == 1], [r for r in out if r["quality"] == 0]
    assert np.mean([r["predicted"] for r in good]) > 0.97 and np.mean([r["predicted"] for r in bad]) < 0.2
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    out = subword.classify(spark, odd, labels)
    assert out.count() == odd.count() and out.where("score IS NULL OR isnan(score)").count() == 0
    for empty in (labels.limit(0), labels.where("quality = 1")):
        assert subword.classify(spark, odd, empty).count() == odd.count()
    assert subword.classify(spark, none, labels).count() == 0
    again = subword.classify(spark, odd, labels)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_features_by_hand():
    found, rows = subword.buckets(*string_parts(pa.array(["ab cd cd", None, "x"])))
    # words, one repeat, and the 3- and 4-grams of " ab ", " cd ", " cd " and " x "
    assert Counter(rows.tolist()) == {0: 3 + 1 + 6 + 3, 2: 1 + 1} and (found == subword.REPEAT).sum() >= 1


# 10 language


def test_language_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op10_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97


def test_language_odd_rows(spark, odd, none):
    out = {r["doc_id"]: r for r in ppm.identify(spark, odd).collect()}
    assert out[10]["lang_pred"] == out[11]["lang_pred"] == out[20]["lang_pred"] == "und" and out[21]["lang_pred"] != "und"
    assert {r["lang_pred"] for r in out.values()} <= {"en", "fr", "und"}
    assert ppm.identify(spark, none).count() == 0
    assert {r["lang_pred"] for r in ppm.identify(spark, odd.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}


def plain_code_length(texts, text, order=ppm.ORDER):
    """Bits of a text by counting and excluding byte by byte, one language at a time."""
    count = defaultdict(Counter)
    for t in texts:
        b = t.encode()
        for i in range(len(b)):
            for d in range(min(i, order) + 1):
                count[b[i - d : i]][b[i]] += 1

    def share(context, byte, all_):
        """The probability of a byte after a context, in the whole distribution there."""
        if all_ is None:
            return 1 / 256
        seen = count.get(context)
        shorter = (context[1:], True) if context else (b"", None)
        if not seen:
            return share(shorter[0], byte, shorter[1])
        total = sum(seen.values()) + len(seen)
        if byte in seen:
            return seen[byte] / total
        left = 1 - sum(share(shorter[0], s, shorter[1]) for s in seen)
        return len(seen) / total * share(shorter[0], byte, shorter[1]) / left

    b = text.encode()
    return sum(-np.log2(share(b[max(0, i - order) : i], b[i], True)) for i in range(len(b)))


def test_code_lengths_equal_a_plain_model():
    texts = {"a": ["the oak and the elm stand by the river", "the the oak", "日本 oak"], "b": ["der baum und der fluss stehen da, 1 und 2", "Ünter der Ulme"], "c": ["x"]}
    model = ppm.train(texts)
    cut = ["the river und Oak!", "x", "", "\x00ÿ日 the elm", "stand by der baum", "zzzz 99"]
    want = [[plain_code_length(texts[k], t) for k in "abc"] for t in cut]
    assert np.allclose(ppm.code_lengths(model, *string_parts(pa.array(cut))), want, rtol=1e-5)


def test_every_context_is_kept():
    rng = random.Random(3)
    texts = {"a": ["".join(rng.choice("abcdefghijklmnop qrst") for _ in range(60_000))], "b": ["short"]}
    b = texts["a"][0].encode()
    kept = {int(k) & (1 << 32) - 1 for k in ppm.train(texts).contexts.keys if int(k) >> 32 == 4}
    assert kept >= {int.from_bytes(b[i - 4 : i], "big") for i in range(4, len(b))} and len(kept) > 12_000


def test_the_sample_is_bounded(spark):
    one = next(i for i in range(20) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(one, f"text {i} of one id", "en") for i in range(50)] + [(one, "text 1 of one id", "en")] * 50 + [(i, "word " * 300, "de") for i in range(20, 60)]
    out = ppm.sample(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), 9, 6000)
    assert len(out["en"]) == 1 and len(out["de"]) == 4
