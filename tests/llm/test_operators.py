"""Every operator against a brute-force version, on whole small tables and on the odd cases."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from cases import ROWS, clashing, documents

from palimpsest.llm import chat, common, digest, langid, lattice, packing, pii, quality, queries, simhash, streaming_viterbi, substring, tokens, tokenstore

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(documents(spark)).cache()


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def key(r):
    return tuple((x is not None, str(x)) for x in r)


# --- substring dedup


def removed(rows, window=20):
    """(doc_id, n_words, n_removed, digest) by looking up every window."""
    ws = [(-(2**63) if i is None else i, WORD.findall(t or "")) for i, t in rows]
    first: dict = {}
    for i, w in ws:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for (i, _), (n, w) in zip(rows, ws):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (n, s):
                gone.update(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=key)


def test_substring_dedup(docs, real):
    for df in (docs, real):
        assert sorted(map(tuple, substring.query(df).collect()), key=key) == removed(texts(df))


def generated(spark):
    rng = np.random.default_rng(3)
    base = [f"v{x}" for x in rng.integers(0, 4, 400)]  # few words, so chance repeats are many
    rows = []
    for i in range(60):
        a, n = int(rng.integers(0, 300)), int(rng.integers(0, 100))
        w = base[a : a + n]
        if n and rng.random() < 0.7:
            w[int(rng.integers(0, n))] = f"new{i}"
        rows.append((i, " ".join(w), None, None, None))
    return documents(spark, rows)


@pytest.mark.parametrize("hot", [1, 7, 1000])
def test_substring_dedup_generated(spark, monkeypatch, hot):
    """With no key, some and all keys taken for hot."""
    monkeypatch.setattr(common, "HOT", hot)
    df = generated(spark)
    assert sorted(map(tuple, substring.query(df).collect()), key=key) == removed(texts(df))


def test_factors_stand_in_the_reference(spark, docs):
    for df in (docs, generated(spark)):
        w = {common.NULL_ID if i is None else i: WORD.findall(t or "") for i, t in texts(df)}
        found = [tuple(common.NULL_ID if x is None and k in (0, 3) else x for k, x in enumerate(r)) for r in substring.parse(df).collect()]
        gone = collections.defaultdict(set)
        for i, start, n, source, at in found:
            assert n >= 20 and w[i][start : start + n] == w[source][at : at + n] and (source, at) < (i, start)
            gone[i].update(range(start, start + n))
        assert {i: len(x) for i, x in gone.items()} == {common.NULL_ID if i is None else i: k for i, _, k, _ in removed(texts(df)) if k}


def test_factors_are_longest():
    """One passage of one source is one factor, however its blocks lie; a jump in the source begins another."""
    got = substring.factors(*map(np.array, ([0, 5, 12, 40, 30], [25, 30, 40, 70, 50], [3, 3, 3, 3, 9], [100, 105, 112, 300, 0])))
    assert [x.tolist() for x in got] == [[0, 30, 40], [40, 50, 70], [3, 9, 3], [100, 0, 300]]


def test_cut_keeps_columns_and_first_places(spark, docs):
    out = substring.cut(docs)
    assert out.columns == docs.columns
    by = {r.doc_id: r for r in out.collect()}
    assert "passage5 " in by[0].text and "passage5 " not in by[1].text
    assert by[1].text == "Other words come first here, then: and an end" and by[1].n_chars == len(by[1].text)
    assert 8 not in by and by[9].text == "changed" and by[2].text is None and by[4].text == ROWS[4][1]


# --- SimHash


def reference_fingerprint(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for _, text, *_ in ROWS:
        assert simhash.fingerprint(text) == reference_fingerprint(text)


def components_of(fps, within=2):
    ids, root = sorted(fps), {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if bin(fps[i] ^ fps[j]).count("1") <= within:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_query(real, docs):
    for df in (real, docs):
        found = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.query(df).collect()]
        assert len(found) == df.count()
        low = common.NULL_ID
        fps = {low if i is None else i: f for i, f, _ in found}
        assert fps == {low if i is None else i: reference_fingerprint(t) for i, t in texts(df)}
        want = components_of(fps)
        assert {low if i is None else i: low if c is None else c for i, _, c in found} == want


@pytest.mark.parametrize("within", [1, 2])
def test_links_of_a_large_group(spark, monkeypatch, within):
    """Hundreds of fingerprints around one centre: the way by neighbours, and pairs, find what brute force finds."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**62))
    near = {centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False)) for _ in range(150)}
    far = {int(x) for x in rng.integers(0, 2**62, 50)}
    fps = dict(enumerate(sorted(near | far)))
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in fps.items()]
    df = spark.createDataFrame(rows, "fp long, rep long")
    want = {i: c for i, c in components_of(fps, within).items() if i != c}
    for bucket in (4, 10_000):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        assert {r.node: r.root for r in common.components(simhash.links(df, within)).collect()} == want


def test_allocation_is_cheapest():
    cost = [[0, 5, 9, 40], [0, 1, 30, 90], [0, 8, 9, 10]]
    import itertools

    want = min(sum(cost[i][e] for i, e in enumerate(es)) for es in itertools.product(range(4), repeat=3) if sum(es) == 3)
    assert simhash.allocate(cost, 3)[0] == want


def test_components_of_long_chains(spark):
    n = 200
    rows = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (7, 7)]
    found = {r.node: r.root for r in common.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, n + 1)} | {1001: 1000}


def test_near_dedup_keeps_one(docs):
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 7 in ids and 8 not in ids and ids.count(None) == 1 and 16 in ids and 17 not in ids
    assert len({2, 3, 4} & set(ids)) == 1


# --- chat


def test_chat_query(spark, duck):
    got = queries.QUERIES["op2_chat"](spark, SF).toPandas().sort_values("conv_id").reset_index(drop=True)
    want = duck.sql(queries.ORACLE_SQL["op2_chat"]).df().sort_values("conv_id").reset_index(drop=True)
    assert got[want.columns].equals(want)


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a & b &lt;| <| &amp;lt;|"), (1, 1, "assistant", "a & b &lt;| <| &amp;lt;|"), (2, None, "role\nwith line", "x\ny\n"), (None, 0, None, ""), (3, 0, "assistant", chat.TRICK)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    got = {r.conv_id: r for r in chat.query(df).collect()}

    def digest_of(*turns):
        return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()

    twice = rows[1][3]
    assert got[1].turns_sha256 == digest_of(("user", ""), ("assistant", twice), ("assistant", twice)) and got[1].n_turns == 3
    assert got[1].loss_chars == 2 * len(twice) and got[1].loss_sha256 == hashlib.sha256((twice * 2).encode()).hexdigest()
    assert got[2].turns_sha256 == digest_of(("role\nwith line", "x\ny\n")) and got[None].turns_sha256 == digest_of(("", ""))
    assert got[-1].loss_sha256 == hashlib.sha256(chat.TRICK.encode()).hexdigest()


def test_chat_events(spark):
    log = [
        (1, 1, "message", 1, "user", "hi"), (1, 2, "message", 2, "assistant", ""), (1, 3, "delta", 2, None, "Hel"), (1, 4, "delta", 2, None, "lo"), (1, 5, "regenerate", 2, None, ""), (1, 6, "delta", 2, None, "Good "),
        (1, 7, "delta", 2, None, "day"), (1, 8, "edit", 1, None, "hello"), (1, 9, "message", 3, "user", "oops"), (1, 10, "delete", 3, None, None), (1, 11, "message", 4, "user", "gone"), (1, 12, "delete", 4, None, None), (1, 13, "edit", 4, None, "back"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, target long, role string, text string")
    got = [(r.role, r.text) for r in chat.reconstruct(df).orderBy("position", "tie").collect()]
    assert got == [("user", "hello"), ("assistant", "Good day"), ("user", "back")]
    assert chat.read_back(chat.render(chat.reconstruct(df))).first().loss_chars == len("Good day")


# --- token ids


def stored(rows, encode):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], str(r[1]))):
        ids = np.array([*encode(t or ""), 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_store(real, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.public_vocabulary("word_bpe_49k.json"))
    encode = lambda x: t.encode(x, add_special_tokens=False).ids
    for df in (real, docs):
        got = sorted(map(tuple, tokenstore.query(df).collect()), key=lambda r: r[1])
        assert got == stored(texts(df), encode)


def test_token_store_in_many_shards(spark, real, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenstore, "BUCKET", 16)
    monkeypatch.setattr(tokenstore, "SHARD", 20_000)
    path = f"file://{tmp_path}/store"
    same = [(10**6, f"same key, text {k} " + "word " * 3000) for k in range(40)]  # over several shards
    more = real.select("doc_id", "text").union(spark.createDataFrame(same, "doc_id long, text string"))
    tokenstore.write_store(more, path)
    t = Tokenizer.from_file(tokens.public_vocabulary("word_bpe_49k.json"))
    by = dict(texts(real))
    got = tokenstore.fetch(spark, path, [3, 77, 10**6, 123456789])
    for i in (3, 77):
        assert got[i][0].tolist() == [*t.encode(by[i], add_special_tokens=False).ids, 2]
    assert {x.tobytes() for x in got[10**6]} == {np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u2").tobytes() for _, x in same} and len(got[10**6]) == 40 and 123456789 not in got
    # access to a key: one row group of one file of the index and of the shards
    import pyarrow.parquet as pq

    about = spark.read.parquet(f"{path}/about").first()
    row = tokenstore.locate(spark, path, spark.createDataFrame([(77,)], "id long")).first()
    b = spark.createDataFrame([(77,)], "id long").select(tokenstore._bucket(about.n_buckets)).first()[0]
    for rows, column, number in ((tokenstore.bucket_rows(spark, path, about, b), "bucket", b), (tokenstore.shard_rows(spark, path, row.task, row.shard), "shard", row.shard)):
        (file,) = rows.inputFiles()
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert f"EqualTo({column},{number})" in plan and "Sort" not in plan and rows.count() == 1
        groups = pq.ParquetFile(file.removeprefix("file://")).metadata
        assert groups.num_row_groups == groups.num_rows > 1


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(2**62), 2**62, 5000))
    levels = tokenstore.build_levels(keys)
    assert sorted(tokenstore.slots_of(levels, keys).tolist()) == list(range(len(keys)))
    assert len(levels) * 8 < 5 * len(keys)
    strange = rng.integers(-(2**62), 2**62, 5000)
    at = tokenstore.slots_of(levels, strange)
    table = np.zeros(len(keys), np.uint32)
    table[tokenstore.slots_of(levels, keys)] = tokenstore._mark(keys)
    assert (table[at[at >= 0]] == tokenstore._mark(strange[at >= 0])).sum() == 0


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_encode_like_whole_texts(real, name, spaced, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 2000)  # the cache turns over
    monkeypatch.setattr(tokens, "BLOCK", 20_000)
    own = tokens.Encoder(tokens.public_vocabulary(name), spaced)
    odd = [
        None, "", " lead", "tail ", "a \nb", "\nfirst\n\nx", "\x00a b\x00 c", "  ", "\n", "a\tb c\t d", "x\n y", "q\n\n  z\r\n w", "a  \n b", "don't <|endoftext|> it's ... \t q", "é ́x \xa0", "\x1c a\x1d b", "İSTANBUL ß ΑΣ", "École, ÉCOLE. x., y.,z b,, 3.14, can't, it'S.",
        "a<|startoftext|>b c <| d", "A <|ENDOFTEXT|> B The THE", "\U0001d400b, 你好. 　x",
    ]
    all_texts = odd + [t for _, t in texts(real)] + [t for _, t, *_ in ROWS]
    want = [x.ids for x in own.tokenizer.encode_batch([t or "" for t in all_texts], add_special_tokens=False)]
    assert [np.frombuffer(x, own.dtype).tolist() for x in own(all_texts)] == want


# --- language


def test_language(spark, real, docs):
    out = langid.query(real).join(real.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    odd = langid.query(docs).toPandas()
    assert len(odd) == len(ROWS) and odd.score.between(0, 1).all()
    by = odd.dropna(subset="doc_id").set_index("doc_id").lang_pred
    assert (by[[2.0, 3.0, 4.0, 15.0]] == "und").all() and (by[[7.0, 8.0]] != "und").all()


def test_forward_sums_all_segmentations():
    pieces = lattice.Pieces(["a", "b", "ab", "ba", "aba", "▁", "▁a"])
    table = np.full((8, 1), 1e-7)
    table[:7, 0] = [0.2, 0.1, 0.3, 0.05, 0.15, 0.1, 0.1]
    p = dict(zip(pieces.pieces, table[:7, 0]))

    def brute(s):
        return 1.0 if not s else sum((p.get(s[:k], 1e-7 if k == 1 else 0)) * brute(s[k:]) for k in range(1, len(s) + 1))

    strings = ["a", "▁abab", "ba?b", "▁aababab", "abaabaab"]
    got = np.exp(langid.likelihoods(pieces, table, strings))[:, 0]
    assert np.allclose(got, [brute(s) for s in strings], rtol=1e-9)


def test_long_words_are_summed_whole():
    """Beyond what doubles hold, against exact fractions; and the way of short words against that of long ones."""
    from fractions import Fraction

    pieces = lattice.Pieces(["a", "b", "ab", "ba", "aba", "▁", "▁a", "bbbb"])
    rng = np.random.default_rng(8)
    table = np.vstack([rng.random((8, 3)) / 20, np.full((1, 3), 1e-7)])
    for n, block in ((120, 50_000), (700, 90)):
        word = "▁" + "".join(rng.choice(list("aabb?"), n))
        got = langid.long_likelihood(pieces, table, word, block)
        for k in range(3):
            p = {x: Fraction(table[i, k]) for i, x in enumerate(pieces.pieces)}
            alpha = [Fraction(1)]
            for end in range(1, len(word) + 1):
                ways = ((m, p.get(word[end - m : end], Fraction(1e-7) if m == 1 and word[end - 1] not in p else 0)) for m in range(1, min(4, end) + 1))
                alpha.append(sum(alpha[end - m] * x for m, x in ways))
            assert got[k] == pytest.approx(math.log(alpha[-1].numerator) - math.log(alpha[-1].denominator), rel=1e-9)
        assert (got < -300).all() if n == 700 else True
    words = ["▁" + "".join(rng.choice(list("ab?"), n)) for n in (1, 5, 20, 40)]
    assert np.allclose(langid.likelihoods(pieces, table, words), [langid.long_likelihood(pieces, table, w, 7) for w in words], rtol=1e-9)


def test_language_sample(spark):
    """Bounded for each language, whatever repeats: a third of the rows has one id."""
    rows = [(i, f"text {i}", "en", None, None) for i in range(3000)] + [(7, "same", "en", None, None)] * 1500 + [(i, "texte", "fr", None, None) for i in range(20)] + [(None, "x", "fr", None, None), (1, None, "fr", None, None)]
    got = collections.Counter(r.lang for r in langid.sampled(documents(spark, rows), 50).collect())
    assert got == {"en": 50, "fr": sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(20))}


def test_learning_raises_the_likelihood():
    pieces = lattice.Pieces(["a", "b", "c", "ab", "abc", "bc"])
    counts = {"abc": 50, "ab": 10, "c": 5, "bca": 3}
    p = langid.learn(pieces, counts)
    flat = np.full((7, 1), 1 / 6)
    score = lambda t: (langid.likelihoods(pieces, t, list(counts))[:, 0] * list(counts.values())).sum()
    assert score(p[:, None]) > score(flat) and abs(p[:-1].sum() - 1) < 1e-9


# --- pseudonyms


def masked(spark, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")
    return [(r.n_masked, r.text) for r in pii.query(rows).orderBy("doc_id").collect()]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_keep_their_format(spark):
    (n, card), (_, mail), (_, day), (_, ip), (_, phone), (_, iban) = masked(spark, "pay 4111 1111 1111 1111 now", "to bob.smith99@mail.example.com.", "on 29.02.2024", "at 192.168.1.254:80", "call +1 (413) 555-3797", "DE89 3704 0044 0532 0130 00")
    digits = re.sub(r"\D", "", card)
    assert n == 1 and luhn(digits) and digits != "4" + "1" * 15 and re.fullmatch(r"pay \d{4} \d{4} \d{4} \d{4} now", card)
    assert re.fullmatch(r"to [a-z]{3}\.[a-z]{5}\d\d@mail\.example\.com\.", mail) and "bob" not in mail
    assert re.fullmatch(r"on \d\d\.\d\d\.\d{4}", day) and day != "on 29.02.2024"
    assert all(int(x) < 256 for x in re.fullmatch(r"at ([\d.]+):80", ip)[1].split("."))
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4}", phone) and phone != "call +1 (413) 555-3797"
    plain = iban.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 and plain[4:] != "370400440532013000"


def test_equal_values_stay_linked(spark):
    (_, a), (_, b), (_, c) = masked(spark, "x 4111111111111111", "y 4111 1111 1111 1111 z", "w 4111111111111129 v")
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != re.sub(r"\D", "", c)


def test_invalid_values_and_clean_texts_stay(spark):
    rows = ["card 4111111111111112", "ip 300.1.1.1 and version 2.0.1", "on 2023-02-29", "ssn 000-12-3456", "DE89370400440532013001", "plain words, 42 of them", None, ""]
    assert masked(spark, *rows) == [(0, r) for r in rows]


def test_permutation_is_one_to_one(spark):
    days = [f"{d:02d}.03.{y}" for y in range(1990, 2010) for d in range(1, 32)]
    ips = [f"10.0.{a}.{b}" for a in range(8) for b in range(100)]
    for values in (days, ips):
        out = [t for _, t in masked(spark, *values)]
        assert len(set(out)) == len(values)
        assert sum(a == b for a, b in zip(values, out)) < 3


def test_masking_keeps_columns(docs):
    out = pii.mask(docs, "key")
    assert out.columns == docs.columns and out.count() == len(ROWS)
    by = {r.doc_id: r.text for r in out.collect()}
    assert "bob.smith" not in by[13] and "4111111111111111" not in by[13] and by[7] == ROWS[7][1] and by[2] is None


# --- sentencepiece


def best_score(codec, symbols):
    best = [0.0] + [-1e300] * len(symbols)
    for i in range(len(symbols)):
        for n in range(1, min(codec.longest, len(symbols) - i) + 1):
            found = codec.score.get(symbols[i : i + n])
            if found:
                best[i + n] = max(best[i + n], best[i] + found[0])
        if symbols[i] not in codec.score:
            best[i + 1] = max(best[i + 1], best[i] + codec.worst)
    return best[-1]


def test_streaming_viterbi_is_optimal(real):
    codec = streaming_viterbi.Codec(tokens.public_vocabulary("piece_bpe_32k.model"))
    rng = np.random.default_rng(2)
    samples = [t[:300] for _, t in texts(real)[:40]] + ["".join(rng.choice(list("abcdeéß語"), 500)) for _ in range(5)] + ["x" * 700, "ab" * 400]
    for text in samples:
        symbols = "▁" + text.replace(" ", "▁")
        score, k = 0.0, 0
        by_id = {i: s for s, i in codec.score.values()}
        ids = list(codec.stream(symbols))
        while k < len(ids):
            if ids[k] in codec.value:  # the bytes of one character
                n = 1 if codec.value[ids[k]] < 0x80 else 2 if codec.value[ids[k]] < 0xE0 else 3 if codec.value[ids[k]] < 0xF0 else 4
                score, k = score + codec.worst, k + n
            else:
                score, k = score + by_id[ids[k]], k + 1
        assert score == pytest.approx(best_score(codec, symbols), rel=1e-12)
        assert codec.decode(codec.encode(text).tolist()) == text
        assert codec.encode(text).tolist() == ids


def test_streaming_viterbi_commits_early():
    codec = streaming_viterbi.Codec(tokens.public_vocabulary("piece_bpe_32k.model"))
    fed = 0

    def symbols():
        nonlocal fed
        for c in "abcdefgh" * 2000:
            fed += 1
            yield c

    next(codec.stream(symbols()))
    assert fed <= 8 * codec.longest


def test_sentencepiece_round_trip(docs):
    out = streaming_viterbi.query(docs).collect()
    assert len(out) == len(ROWS) and all(r.text_sha256 == r.decoded_sha256 for r in out)
    back = streaming_viterbi.decode(streaming_viterbi.encode(docs)).groupBy("text").count().collect()
    assert {r.text: r["count"] for r in back} == collections.Counter(t or "" for _, t, *_ in ROWS)


# --- digests


def digest_by_hand(text):
    """The digest in plain integers: counts of three kinds of triplets, quartiles by sorting, two bits for each bucket."""
    raw, n = (text or "").encode(), [0] * 128
    for k, (i, j, m) in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 3)), 1):
        for at in range(len(raw) - m):
            x = raw[at + i] * 0x9E3779B1 + raw[at + j] * 0x85EBCA77 + raw[at + m] * 0xC2B2AE3D + k * 0x27D4EB2F & 0xFFFFFFFF
            x = (x ^ x >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
            n[x >> 25] += 1
    q = sorted(n)
    q1, q2, q3 = q[31], q[63], q[95]
    levels = [sum(c > x for x in (q1, q2, q3)) for c in n]
    body = bytes(sum(levels[4 * k + j] << 2 * j for j in range(4)) for k in range(32))
    return bytes([min(255, round(8 * math.log2(len(raw) + 1))), 255 * q1 // max(q3, 1), 255 * q2 // max(q3, 1)]) + body


def likeness_by_hand(a, b):
    score = min(60, 2 * abs(a[0] - b[0])) + min(15, abs(a[1] - b[1]) // 4) + min(15, abs(a[2] - b[2]) // 4)
    for x, y in zip(a[3:], b[3:]):
        score += sum((0, 1, 2, 6)[abs((x >> s & 3) - (y >> s & 3))] for s in (0, 2, 4, 6))
    return 1 - min(256, score) / 256


@pytest.mark.parametrize("drawn", [60, 1])
def test_digest_query(real, docs, monkeypatch, drawn):
    monkeypatch.setattr(digest, "DRAWN", drawn)
    for df in (real.where("doc_id < 60"), docs):
        rows = sorted(texts(df), key=lambda r: (-(2**63) if r[0] is None else r[0], str(r[1])))
        want = []
        for k, (i, t) in enumerate(rows):
            t, other = t or "", rows[(k + 1) % len(rows)][1] or ""
            half = len(t) // 2
            changed = t[: len(t) - half] + other[:half]
            a, b, c = map(digest_by_hand, (t, changed, other))
            want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), a.hex(), b.hex(), likeness_by_hand(a, b), likeness_by_hand(a, c)))
        assert sorted(map(tuple, digest.query(df).collect()), key=key) == sorted(want, key=key)


def test_digest_tells_edited_from_other(real):
    out = digest.query(real).toPandas()
    assert out.near_edited.mean() > out.near_next.mean() + 0.3
    values = np.r_[out.near_edited, out.near_next]
    ranks = np.argsort(np.argsort(values))[: len(out)]
    assert (ranks.mean() - (len(out) - 1) / 2) / len(out) > 0.85  # area under the curve


def test_digest_of_one_and_of_likeness(spark):
    (r,) = digest.query(documents(spark, [(1, "abcdefgh", None, None, None)])).collect()
    assert r.near_next == 1.0 and len(r.fingerprint) == 70
    a, b = "the cat sat on the mat " * 40, "zebra quux 123 !? " * 40
    assert digest.likeness(digest.fingerprint(a), digest.fingerprint(a + "x")) > 0.9 > 0.5 > digest.likeness(digest.fingerprint(a), digest.fingerprint(b))


def test_triplets_in_blocks(monkeypatch):
    raw = np.random.default_rng(0).integers(0, 256, (1 << 20) + 5000, np.uint8).tobytes()
    n = len(raw)
    assert digest.counts(raw).sum() == (n - 2) + 2 * (n - 3)
    assert (digest.counts(raw[:100]) == digest.counts(raw[:100])).all() and digest.counts(b"ab").sum() == 0


# --- packing


def test_packing_query(real, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.public_vocabulary("byte_bpe_50k.json"))
    for df in (real, docs):
        got = packing.query(df).collect()
        pieces = collections.Counter()
        for i, text in texts(df):
            ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            first = len(ids) % 1024 or 1024
            cuts = [0, *range(first, len(ids) + 1, 1024)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                pieces[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
        by = collections.defaultdict(list)
        for r in got:
            by[r.sequence_id].append((r.offset, r.length))
        for own in by.values():
            own.sort()
            assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024


@pytest.mark.parametrize("kind", ["uniform", "large", "hot", "small", "one"])
def test_plans(kind):
    rng = np.random.default_rng(4)
    lengths = {"uniform": rng.integers(1, 1025, 5000), "large": rng.integers(300, 600, 3000), "hot": np.r_[np.full(2000, 400), rng.integers(1, 1025, 4000)], "small": rng.integers(1, 50, 2000), "one": np.array([7])}[kind]
    counts = np.bincount(lengths, minlength=1025)
    p = packing.best_plan(counts, 1024)
    fill = np.zeros(p.bins, int)
    for n in np.flatnonzero(counts):
        at = 0
        for _, rank, many, *_ in sorted(r for r in p.runs if r[0] == n):
            assert rank == at
            at += many
        assert at == counts[n]
    for n, _, many, base, offset in sorted(p.runs, key=lambda r: r[4]):
        assert (fill[base : base + many] == offset).all()
        fill[base : base + many] += n
    least = -(-int(lengths.sum()) // 1024)
    assert fill.max() <= 1024 and p.bins <= (least if kind == "one" else 1.04 * least + 2 if kind != "hot" else 1.11 * least)


# --- quality


def rules(text):
    w, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = collections.Counter(tri)
    covered = {k for i, g in enumerate(tri) if times[g] > 1 for k in (i, i + 1, i + 2)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_rules(spark, real, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for df in (real, docs):
        got = [(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in quality.query(df, labels).collect()]
        assert sorted(got, key=key) == sorted([(i, rules(t)) for i, t in texts(df)], key=key)


def test_base_rules_in_sql(spark, duck):
    got = queries.QUERIES["quality_base_rules"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = duck.sql(queries.ORACLE_SQL["quality_base_rules"]).df().sort_values("doc_id").reset_index(drop=True)
    assert got[want.columns].equals(want)


def test_quality_verdict(spark, real):
    """Scores by hand from the hashes."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in labels.collect() if r.quality == 1}

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def grams(text):
        h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in WORD.findall(text or "")]
        pairs = []
        for a, b in zip(h, h[1:]):  # each value is hashed with the hash before it as seed
            first = xxhash.xxh64_intdigest(int(a).to_bytes(8, "little", signed=True), 42)
            pairs.append(signed(xxhash.xxh64_intdigest(int(b).to_bytes(8, "little", signed=True), first)))
        return [x % quality.BUCKETS for x in h + pairs]

    own = {i: grams(t) for i, t in texts(real)}
    raw, target = collections.Counter(), collections.Counter()
    trusted = {t for i, t in texts(real) if i in good}
    for t in {t for _, t in texts(real)}:  # a text counts once, however often it is copied
        g = grams(t)
        raw.update(g)
        if t in trusted:
            target.update(g)
    n, t = sum(raw.values()), sum(target.values())
    weight = {b: np.log(((target[b] / t) / (raw[b] / n) + quality.FLOOR) / (1 + quality.FLOOR)) for b in raw}
    for r in quality.query(real, labels).collect():
        want = np.mean([weight[b] for b in own[r.doc_id]]) if own[r.doc_id] else None
        assert r.score == pytest.approx(want, abs=1e-5) if want is not None else r.score is None
        if want is not None and abs(want - quality.THRESHOLD) > 1e-4:
            assert r.kept == (not r.base_failed and want >= quality.THRESHOLD)


def test_quality_separates_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.query(docs, labels).where("NOT base_failed").join(labels, "doc_id").toPandas()
    assert out[out.quality == 1].kept.mean() > 0.998 and (~out[out.quality == 0].kept).mean() > 0.97


def test_quality_without_trusted_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept == (not r.base_failed) for r in quality.query(docs, none).collect())
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 1}


# --- empty tables


@pytest.mark.parametrize("name", [k for k in queries.QUERIES if k not in ("op2_chat", "op10_quality", "op13_search")])
def test_empty_documents(spark, tmp_path, name):
    documents(spark, []).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert queries.QUERIES[name](spark, f"file://{tmp_path}").count() == 0


def test_empty_others(spark, tmp_path):
    documents(spark, []).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert queries.QUERIES["op10_quality"](spark, f"file://{tmp_path}").count() == 0
    assert queries.QUERIES["op13_search"](spark, f"file://{tmp_path}").count() == 0
    assert queries.QUERIES["op2_chat"](spark, f"file://{tmp_path}").count() == 1
