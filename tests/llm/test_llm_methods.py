"""The methods themselves, against plain versions on small inputs."""

import random

import numpy as np
import pytest

from clausemesh.llm import decontamination, language, line_dedup, merkle, quality, secrets, sentencepiece_codec, sharding, simhash, warc
from clausemesh.llm.common import components


def frame(spark, texts, **more):
    rows = [(i, t, *[v[i] for v in more.values()]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {k} string" for k in more))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(80)}, 5000: 5000, 5001: 5000}


# --- near copies ---------------------------------------------------------------------------------


def links_of(prints, budget=4):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= budget):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return {int(prints[i]): int(prints[find(i)]) for i in range(len(prints)) if find(i) != i}


def clouds(seed, n, m):
    rng = np.random.default_rng(seed)
    out = [rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)]
    for bits in (1, 2, 3):
        centre = int(rng.integers(0, 2**63))
        out.append(np.array([centre ^ sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in range(m)], dtype=np.uint64))
    return np.unique(np.concatenate(out))


@pytest.mark.parametrize("block", [1 << 17, 50])
def test_trie_walk(block):
    prints = clouds(3, 400, 120)
    a, b = simhash.walk_pair(prints, 0, 0, 0, block=block)
    assert {int(y): int(x) for x, y in zip(a.view(np.uint64), b.view(np.uint64))} == links_of(prints)


def test_trie_join_on_spark_splits_dense_nodes(spark):
    prints = clouds(4, 300, 100)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    links = simhash.links(df, node_rows=40)
    got = {r.node: r.root for r in components(links).collect()}
    unsigned = {k % 2**64: v % 2**64 for k, v in got.items() if k != v}
    want = links_of(prints)
    low = {}
    for k, v in want.items():
        low.setdefault(v, {v}).add(k)
    mine = {}
    for k, v in unsigned.items():
        mine.setdefault(v, {v}).add(k)
    assert sorted(map(sorted, low.values())) == sorted(map(sorted, mine.values()))


# --- lines ---------------------------------------------------------------------------------------


def plain_line_dedup(docs, min_words):
    """Delete lines of runs of min_words words that occur earlier; all runs are tried."""
    lines = {i: t.split("\n") for i, t in docs}
    first, gone = {}, {i: set() for i in lines}
    for i in sorted(lines):
        for a in range(len(lines[i])):
            for z in range(a + 1, len(lines[i]) + 1):
                run = tuple(lines[i][a:z])
                if sum(len(x.split()) for x in run) >= min_words:
                    if run in first:
                        gone[i] |= set(range(a, z))
                    else:
                        first[run] = (i, a)
    return {i: "\n".join(x for k, x in enumerate(ls) if k not in gone[i]) for i, ls in lines.items()}


@pytest.mark.parametrize("seed, min_words", [(0, 1), (1, 4), (2, 7), (3, 12)])
def test_line_dedup_deletes_maximal_runs(spark, seed, min_words):
    rng = random.Random(seed)
    vocabulary = ["a", "b b", "c c c", "", "d", "e e"]
    docs = [(i, "\n".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14)))) for i in range(14)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, min_words=min_words).collect()}
    assert got == plain_line_dedup(docs, min_words)


def test_ranks_follow_the_suffix_order(spark):
    """After doubling, ranks order the repeated suffixes as their line-id sequences do."""
    docs = [(0, "x\ny\nx\ny\nz"), (1, "y\nx\ny\nx\ny\nz"), (2, "z\nx\ny")]
    df = spark.createDataFrame(docs, "k_id long, text string").selectExpr("k_id", "0L AS k_h", "text")
    runs = line_dedup._shortest_runs(line_dedup._lines(df), 1)
    ids = line_dedup.line_ids(runs)
    one = runs.join(ids, ["h1", "h2"]).select("k_id", "k_h", "pos", "rank")
    two = line_dedup.doubled(one, 1)
    line = {(r.k_id, r.pos): r["rank"] for r in one.collect()}
    pair = {(r.k_id, r.pos): r["rank"] for r in two.collect()}
    key = lambda p: (line[p], line[(p[0], p[1] + 1)])
    assert pair and all((pair[p] < pair[q]) == (key(p) < key(q)) and (pair[p] == pair[q]) == (key(p) == key(q)) for p in pair for q in pair)


# --- shards, secrets, fingerprints ---------------------------------------------------------------


def test_lookup_table_is_balanced_and_stable():
    names = [f"s{i}" for i in range(10)]
    full, less = sharding.lookup_table(names, 10_007), sharding.lookup_table(names[:-1], 10_007)
    counts = np.bincount(full)
    assert counts.max() - counts.min() <= 1
    stayed = np.mean([a == b for a, b in zip(full, less) if a != 9])
    assert stayed > 0.85
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 10_000)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"], 7)


def test_write_shards_keeps_all_rows(spark, tmp_path):
    df = spark.range(500).selectExpr("id", "id AS slot", "'x' AS shard")
    sharding.write_shards(df, df.id, ["a", "b", "c"], str(tmp_path / "out"), size=101)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 500 and {"shard", "slot", "shard_"} <= set(got.columns) and got.select("shard_").distinct().count() == 3


def test_ledger_scans_unseen_pairs_only(spark):
    secret = "password = hunter22x"
    one = spark.createDataFrame([("a", 1, secret), ("b", 1, "nothing"), ("a", 2, secret)], "path string, version int, text string")
    two = one.union(spark.createDataFrame([("c", 1, secret), ("d", 1, "AKIA" + "B" * 16)], one.schema))
    ledger = secrets.Ledger(spark)
    ledger.update(one)
    assert ledger.rows().count() == 2 * len(secrets.RULES)
    files = lambda: spark.read.parquet(ledger.path).count()
    before = files()
    ledger.update(two)
    assert files() - before == len(secrets.RULES)  # one new blob
    newer = (secrets.Rule("assign", "2", secrets.RULES[0].pattern, 3, 10), *secrets.RULES[1:])
    ledger.update(two, rules=newer)
    assert files() - before == len(secrets.RULES) + 3  # three blobs, one rule
    found = {(r.path, r.version): len(r.assign) for r in ledger.findings(two).collect()}
    assert found == {("a", 1): 1, ("a", 2): 1, ("b", 1): 0, ("c", 1): 1, ("d", 1): 0}
    assert sum(len(r.assign) for r in ledger.findings(two, rules=newer).collect()) == 0


def test_spans_count_code_points_and_do_not_overlap(spark):
    text = "é😀 token: abc, secret=token: abcdefgh, API_KEY = 'A_B-c/9=' AKIA" + "Z" * 15 + " AKIA" + "Z" * 20 + " " + "0a" * 13
    df = spark.createDataFrame([(text,)], "text string").select(*[secrets.spans_of(F_col("text"), r).alias(r.kind) for r in secrets.RULES])
    row = df.first()
    cut = {k: [text[s.start : s.end] for s in row[k]] for k in ("assign", "access", "hex")}
    assert cut == {"assign": ["API_KEY = 'A_B-c/9="], "access": ["AKIA" + "Z" * 20], "hex": ["0a" * 13]}


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_merkle_roots_and_edits():
    text = "\n".join(" ".join(f"w{i}_{j}" for j in range(30)) for i in range(20))
    changed = text.replace("w7_3 ", "new ")
    a, b = merkle.fingerprint(text), merkle.fingerprint(changed)
    assert a != b and a == merkle.fingerprint(str(text)) and merkle.likeness(a, a) == 1
    assert merkle.edits(a, b) == [(7, 8)] and merkle.edits(a, a) == []
    assert 0.9 < merkle.likeness(a, b) < 1 and merkle.likeness(a, merkle.fingerprint("x y z")) == 0
    assert merkle.edits(merkle.fingerprint("a\nb\nb\nc"), merkle.fingerprint("a\nb\nc")) == [(2, 3)]
    for other in (" a", "a ", "a\n", "\na"):
        assert merkle.fingerprint(other).split("/")[0] != merkle.fingerprint("a").split("/")[0]


def slow_tree(text):
    """The fingerprint by its definition, and its leaves with the section and paragraph each is in."""
    import hashlib
    import zlib

    h = lambda b: hashlib.blake2b(b, digest_size=16).digest()
    sections, open_ = [], []
    for paragraph in text.split("\n"):
        leaves, own = [], []
        for word in paragraph.split(" "):
            own.append(word.encode())
            if zlib.crc32(word.encode()) % 8 == 0 or len(own) == 64:
                leaves.append(h(b" ".join(own)))
                own = []
        if own:
            leaves.append(h(b" ".join(own)))
        open_.append((h(b"".join(leaves)), leaves))
        if not paragraph.encode().strip() or open_[-1][0][0] % 8 == 0:
            sections.append(open_)
            open_ = []
    if open_:
        sections.append(open_)
    tops = [h(b"".join(p for p, _ in s)) for s in sections]
    short = lambda b: b.hex()[:10]
    body = ";".join(short(t) + ":" + ",".join(short(p) + "".join(map(short, ls)) for p, ls in s) for t, s in zip(tops, sections))
    return h(b"".join(tops)).hex() + "/" + body, [x for s in sections for _, ls in s for x in ls]


def common_run(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_merkle_against_a_slow_tree():
    import random

    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)] + ["é", ""]
    near = []
    for n in range(30):
        lines = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 7, 40, 200]))) for _ in range(rng.randint(1, 30))]
        text = "\n".join(lines)
        shuffled = list(lines)
        rng.shuffle(shuffled)
        changed = text.split(" ")
        changed[rng.randrange(len(changed))] += "x"
        own, mine = slow_tree(text)
        assert merkle.fingerprint(text) == own and str(merkle.parsed(own)) == own
        for other in ("\n".join(shuffled), " ".join(changed), "new " + text, text + "\nend", text[: len(text) // 2]):
            print_, theirs = slow_tree(other)
            got = merkle.likeness(own, print_)
            assert (got == 1) == (text == other) and got <= 2 * common_run(mine, theirs) / (len(mine) + len(theirs)) + 1e-12
            near.append((got, 2 * common_run(mine, theirs) / (len(mine) + len(theirs))))
    assert sum(a for a, _ in near) > 0.9 * sum(b for _, b in near)
    long = " ".join(rng.choice(words) for _ in range(2000))
    assert merkle.likeness(merkle.fingerprint(long), merkle.fingerprint("new " + long)) > 0.98
    lines = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(60)]
    assert merkle.likeness(merkle.fingerprint("\n".join(lines)), merkle.fingerprint("\n".join(reversed(lines)))) < 0.1


def test_bucket_of_bounds(spark):
    bounds = [3, 5, 8, 13, 21, 34]
    df = spark.range(40).withColumn("b", merkle._bucket(F_col("id"), bounds))
    assert all(r.b == sum(x <= r.id for x in bounds) for r in df.collect())


# --- tokens --------------------------------------------------------------------------------------


def message(*fields):
    def varint(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes(out) + bytes([n])

    import struct

    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3) + varint(value)
    return out


def test_unigram_model_with_bytes_matches_the_original():
    import sentencepiece

    words = {"▁": -3.0, "a": -4.0, "b": -4.1, "c": -4.5, "ab": -5.0, "▁a": -5.5, "▁ab": -6.0, "bc": -5.2, "abc": -7.0, "▁c": -6.1}
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] + [(p, s, 1) for p, s in words.items()]
    body = [(1, message((1, p.encode()), (2, s), (3, k))) for p, s, k in pieces]
    data = message(*body, (2, message((3, 1), (4, len(pieces)), (35, 1), (40, 0), (41, 1), (42, 2))), (3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    model = sentencepiece_codec.parse_model(data)
    assert model.kind == sentencepiece_codec.UNIGRAM and model.byte_fallback and model.dummy_prefix and not model.remove_extra_spaces
    own, original = sentencepiece_codec.backend(model), sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in ["abc", "ab cab", "a  b", " abc ", "é a", "abcabc xyz", "", "c\nab"]:
        assert own.encode(text, add_special_tokens=False).ids == original.encode(text), text
        assert own.decode(own.encode(text, add_special_tokens=False).ids) == text


def test_merge_model_on_odd_texts():
    import sentencepiece

    codec = sentencepiece_codec.Codec(sentencepiece_codec.MODEL)
    original = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    texts = ["", " ", "   a", "a   ", "a  b   c", "<s> </s> <unk> <0x41>", "▁x ▁▁", "\t\n\r", "日本語 😀 ñ", "aaaaaaaaaaaa" * 50, "é" * 30, "x" * 5000, "\u0000a"]
    ids = codec.encode(texts)
    assert ids == original.encode(texts)
    for _ in range(2):  # with new and with remembered words
        found = codec.run(texts)
        assert [i.tolist() for i, _, _ in found] == ids and all(same for _, _, same in found)
        assert [back for _, back, _ in found] == [t == codec.decode([i])[0] for t, i in zip(texts, ids)]
    plain = [t for t in texts if "▁" not in t]
    assert codec.decode(codec.encode(plain)) == plain


def test_codec_forgets_words_and_reports_differences(monkeypatch):
    codec = sentencepiece_codec.Codec(sentencepiece_codec.MODEL)
    monkeypatch.setattr(sentencepiece_codec, "SEEN_WORDS", 3)
    texts = ["a b c", "d e", "a b", "f g h i j"]
    for t in texts:
        assert codec.run([t])[0][0].tolist() == codec.encode([t])[0]
    codec.unequal.add("b")
    codec.lossy.add("e")
    assert [(x, y) for _, x, y in codec.run(texts)] == [(True, False), (False, True), (True, False), (True, True)]


# --- language, quality ---------------------------------------------------------------------------


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = language.new_net(["a", "b", "c"], hidden=3, seed=1)
    for i in (0, 1):
        net.table[i], net.recurrent[i] = net.table[i].astype(np.float64), net.recurrent[i].astype(np.float64)
    steps = rng.integers(97, 123, (6, 4)).astype(np.intp)
    labels = np.array([0, 1, 2, 0])
    _, grads = language.gradients(net, steps, labels)
    for p, g in zip(net.parameters(), grads):
        order = np.argsort(-np.abs(g).ravel())[:4]
        for k in order:
            old = p.flat[k]
            p.flat[k] = old + 1e-2
            up = language.gradients(net, steps, labels)[0]
            p.flat[k] = old - 1e-2
            down = language.gradients(net, steps, labels)[0]
            p.flat[k] = old
            assert abs((up - down) / 2e-2 - g.flat[k]) < 0.02 * abs(g.flat[k]) + 2e-3


def test_segments_cover_every_byte():
    texts = [b"", b"a", b"x" * 64, b"y" * 65, b"", b"z" * 200]
    offsets = np.cumsum([0, *map(len, texts)])
    segments, owner = language._cut(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for i, t in enumerate(texts):
        assert segments[owner == i].tobytes().rstrip(b"\0") == t


def test_pseudo_labels_are_given_and_bounded(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    text = lambda bad: " ".join(rng.choice(words) for _ in range(30)) + (" vile nasty" if bad else " calm kind")
    docs = [(i, text(i % 3 == 0), "en", f"s{i % 3}") for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    got = {r.k_id: r for r in quality.classify(df, labels).collect()}
    assert np.mean([got[i].keep == (i % 3 != 0) for i in range(600)]) > 0.98
    assert np.mean([(got[i].meta_score > 0.5) == (i % 3 != 0) for i in range(600)]) > 0.98


# --- WARC ----------------------------------------------------------------------------------------


def test_members_end_with_zero_and_inflate_alone():
    import gzip

    for record in (b"", b"abc", bytes(range(256)) * 70_000):
        member = warc._member(record)
        assert member[-1] == 0 and gzip.decompress(member) == record


def test_archives_are_plain_warc_files(spark, tmp_path):
    import gzip
    import os

    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{'é\r\n\r\n' * 40}{i % 7}</p>") for i in range(50)], "page_id long, url string, html string")
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    warc.write_archives(warc.capture_plan(pages), raw, records=9)
    warc.normalise(spark, raw, out)
    index = {(r.archive, r.offset): r for r in spark.read.parquet(f"{out}/index").collect()}
    n = 0
    for folder, _, files in os.walk(f"{out}/archives"):
        for name in files:
            if name.endswith(".txt"):
                data = open(os.path.join(folder, name), "rb").read()
                assert [h["warc-record-id"] for h, _ in warc.records(data, 100)] == [h["warc-record-id"] for h, _ in warc.records(data)]
                assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
                archive, at = folder.rpartition("archive=")[2], 0
                while at < len(data):
                    entry = index[(archive, at)]
                    assert gzip.decompress(data[at : at + entry.length]).count(b"WARC/1.1") == 1
                    at, n = at + entry.length, n + 1
    assert n == 50
    got = {r.page_id: r for r in warc.read_archives(spark, out).collect()}
    assert {i: r.refers_to for i, r in got.items()} == {i: i % 7 if i >= 7 else None for i in range(50)}


# --- decontamination -----------------------------------------------------------------------------


def plain_hits(docs, items):
    out = {}
    for i, text in docs:
        words, hit, found = text.split(), set(), set()
        for name, item in items:
            own = item.split()
            n = min(10, len(own))
            windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
            for k in range(len(words) - n + 1):
                if n and tuple(words[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(str(name))
        out[i] = (len(words), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_winnowing_finds_every_shared_window(spark, seed):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(4 if seed == 2 else 300)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, make(rng.choice([1, 3, 9, 10, 11, 25, 40]) if seed < 2 else rng.choice([9, 10, 14]))) for i in range(25)]
    docs = []
    for i in range(60):
        text = make(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(items)[1]
            a = rng.randint(0, max(0, len(item) - 12))
            at = rng.randint(0, len(text))
            text[at:at] = item[a : a + rng.randint(5, 20)]
        docs.append((i, " ".join(text)))
    items = [(i, " ".join(x)) for i, x in items]
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.k_id: (r.n_words, r.n_hit, r["items"]) for r in got.collect()} == plain_hits(docs, items)
