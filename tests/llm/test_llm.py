"""Every operator against a brute-force version on a small table, and on the awkward cases: nulls in any
column, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(data):
    return hashlib.sha256(data).hexdigest()


def corpus(seed=4, n=60):
    """Prose over a small vocabulary, with shared passages, copies and near copies, repeated lines and odd texts."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "été", "naïve", "über", "la"] + [f"w{i}" for i in range(300)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = prose(35)
    texts = [None, "", " \n\t ", "one", "A B c", "a  b\tc\nd", "word " * 400, "x" * 5000, "!!! ### $$$ " * 30, "é🙂 \x0b ½² 'll don't", "\x1c \x1d\x85"]
    while len(texts) < n:
        kind = rng.randrange(6)
        if kind == 0 and len(texts) > 20:
            texts.append(texts[rng.randrange(11, len(texts))])
        elif kind == 1 and len(texts) > 20:
            words = (texts[rng.randrange(11, len(texts))] or "").split(" ")
            if len(words) > 3:
                words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
        elif kind == 2:
            texts.append(prose(rng.randrange(10, 40)) + " " + shared + "\n" + prose(rng.randrange(30)))
        else:
            texts.append("\n".join(prose(rng.randrange(1, 25)) for _ in range(rng.randrange(1, 9))) + "\n" * rng.randrange(2))
    return [(i, t, "en", rng.choice(["a", "b", "B", None]), len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def keyed(df, *columns, key="doc_id"):
    out = {r[key]: tuple(r[c] for c in columns) for r in df.collect()}
    return out


# 1 substring dedup


def brute_substring(rows, width=20):
    seen, out = set(), {}
    for d, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if k in seen:
                gone[i : i + width] = [True] * width
            seen.add(k)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[d] = (len(w), sum(gone), sha(" ".join(kept).encode()))
    return out


def test_substring_dedup(docs, rows, none):
    from siftwork.llm import substring_dedup as op

    assert keyed(op.dedup(docs), "n_words", "n_removed", "kept_sha256") == brute_substring(rows)
    assert op.dedup(none).count() == 0


def test_repeats_are_maximal(spark):
    from siftwork.llm import substring_dedup as op

    passage = " ".join(f"p{i}" for i in range(45))
    df = spark.createDataFrame([(1, f"a b {passage} c"), (2, f"d {passage} e f"), (3, "short"), (4, f"a b {passage} c")], "doc_id long, text string")
    assert sorted(tuple(r) for r in op.repeats(df).collect()) == [(2, 1, 46), (4, 0, 48)]


def thue_morse(k):
    """Words of 2**k letters that differ everywhere and that every polynomial hash modulo 2**64 with an odd step takes for equal."""
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomials_take_for_equal(spark):
    from siftwork.llm import near_dedup, substring_dedup

    a, b = thue_morse(10)
    head, tail = " ".join(f"w{i}" for i in range(12)), " ".join(f"v{i}" for i in range(12))
    runs = ["" + " ".join(x) for x in thue_morse(10)]
    data = [(1, f"{head} {a} {tail}"), (2, f"{head} {b} {tail}"), (3, a), (4, b), (5, runs[0]), (6, runs[1])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert keyed(substring_dedup.dedup(df), "n_words", "n_removed", "kept_sha256") == brute_substring(data)
    assert keyed(near_dedup.near_duplicates(df), "n_shingles", "component_id", "kept") == brute_near(data)


def test_runs_of_words():
    import numpy as np

    from siftwork.llm.bytescan import Runs

    rng = np.random.default_rng(2)
    words = rng.integers(0, 3, 400).astype(np.uint64)
    starts, ends = (x.ravel() for x in np.meshgrid(np.arange(360), np.arange(1, 41)))
    for kind in (1, 2):
        hashes = Runs(words, kind).hash(starts, starts + ends)
        by_run = {}
        for s, n, h in zip(starts.tolist(), ends.tolist(), hashes.tolist(), strict=True):
            assert by_run.setdefault(tuple(words[s : s + n].tolist()), h) == h
        assert len(set(by_run.values())) == len(by_run)


def test_substring_dedup_rows_that_share_an_id(spark):
    """Each row's spans fall on its own text; equal rows are one document; rows without doc_id take nothing."""
    from siftwork.llm import substring_dedup as op

    same = " ".join(f"s{i}" for i in range(40))
    data = [(None, f"q {same}"), (1, same), (2, f"a {same} b"), (1, "short text"), (3, same), (3, same)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in op.dedup(df).collect())
    assert got == [(0, 41, 0), (1, 2, 0), (1, 40, 0), (2, 42, 40), (3, 40, 40), (3, 40, 40)]
    assert sorted(tuple(r) for r in op.repeats(df.where("doc_id < 3")).collect()) == [(2, 1, 41)]


# 2 byte-level BPE


def reference_encoding():
    import base64

    import public_tokenizers
    import tiktoken

    from siftwork.llm.byte_bpe import vocabulary_path

    with open(vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, rows, none):
    from siftwork.llm import byte_bpe as op

    path, enc = op.vocabulary_path(), reference_encoding()
    extra = docs.withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    out = op.decode(op.encode(extra, path, offsets=True), path).collect()
    for r, (_, t, *_rest) in zip(sorted(out), sorted(rows, key=lambda x: x[0]), strict=True):
        assert r["ids"] == enc.encode_ordinary(t or "") and bytes(r["decoded"]) == (t or "").encode() and r["source"] is not False
        data, at, starts, split = (t or "").encode(), 0, [], set()
        for i in r["ids"]:
            inside = at < len(data) and data[at] & 0xC0 == 0x80
            chars = sum(b & 0xC0 != 0x80 for b in data[: at + 1]) - 1
            starts.append(chars)
            if inside:
                split.add(chars)
            at += len(enc.decode_single_token_bytes(i))
        assert r["starts"] == starts and r["n_split_chars"] == len(split)
    assert op.encode(none, path).count() == 0


def test_bpe_fuzz():
    import pyarrow as pa

    from siftwork.llm import byte_bpe as op

    rng, enc = random.Random(9), reference_encoding()
    letters = "aab eerst'' \n\t  1é你¼.!,-_LlsSrve \x1c🙂\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(70))) for _ in range(3000)]
    ids, bounds, _ = op.encode_texts(pa.array(texts), op.vocabulary(op.vocabulary_path()))
    assert all(ids[bounds[i] : bounds[i + 1]].tolist() == enc.encode_ordinary(t) for i, t in enumerate(texts))


def test_split_characters_decode():
    from siftwork.llm import byte_bpe as op

    enc, path = reference_encoding(), op.vocabulary_path()
    ids = enc.encode_ordinary("a🙂你½ z")
    assert "".join(op.decode_stream([[i] for i in ids], path)) == "a🙂你½ z"


def test_ids_without_a_token_have_no_bytes(spark):
    from siftwork.llm import byte_bpe as op

    path, hello = op.vocabulary_path(), reference_encoding().encode_ordinary("hello you")
    data = [(1, [*hello[:1], 100_000_000, -3, None, *hello[1:]]), (2, None), (3, []), (4, [-1]), (5, hello)]
    out = keyed(op.decode(spark.createDataFrame(data, "doc_id long, ids array<int>"), path), "decoded")
    assert {d: bytes(b) for d, (b,) in out.items()} == {1: b"hello you", 2: b"", 3: b"", 4: b"", 5: b"hello you"}


# 3 URL filters


def test_url_filter(spark):
    from siftwork.llm import url_filter as op

    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q#f", "https://example.net/de/", "https://x.net", "http://q.org/fr/1", "http://q.org/FR/1", "https://example.com/de/a", "http://notexample.com/de/a", "ftp://h:80/p://x", "http://?q", "://", "http://a.b/c\nd?e"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: tuple(r)[1:] for r in op.judge(pages, op.hosts_without_https(pages)).collect()}

    def one(url):
        at = (url or "").find("://")
        if at < 0:
            return "", "", None, "allow"
        rest = url[at + 3 :]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
        for rule, verdict in (("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("net/", "block")):
            h, p = rule.split("/", 1)
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                return host, path, rule, verdict
        safe = {hosts(u) for u in urls if u and u[:8].translate(LOWER) == "https://"}
        return host, path, None, "block" if host and host not in safe else "allow"

    def hosts(url):
        return re.match(r"[^/?#]*", url[url.find("://") + 3 :])[0].translate(LOWER)

    assert got == {i: one(u) for i, u in enumerate(urls)}


def test_cascade_is_exact(spark):
    from siftwork.llm import url_filter as op

    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    for most_bits in (op.MOST_BITS, 512):  # one part, and several
        found = op.cascade(keys, most_bits)
        assert len(found.levels) > 2 and (found.parts > 3) == (most_bits == 512)
        assert max(level.size for level in found.levels) <= max(2 * most_bits, 64) or most_bits == op.MOST_BITS
        out = op.with_listed(keys.withColumn("filter_part", F.lit("clash")), "key", found)
        assert out.count() == 4000 and out.where("in_list <> listed or filter_part <> 'clash'").count() == 0
        for all_or_none in (True, False):
            some = keys.withColumn("listed", F.lit(all_or_none))
            assert op.with_listed(some, "key", op.cascade(some, most_bits)).where("in_list = listed").count() == 4000


def op_verdict(rows):
    safe = {u.split("/")[2] for _, u in rows if u and u.startswith("https")}
    return ["block" if u and u.split("/")[2] not in safe else "allow" for _, u in rows]


def test_url_filter_in_parts(spark):
    from siftwork.llm import url_filter as op

    rows = [(i, f"http{'s' * (i % 50 < 20)}://h{i % 50}.x/p") for i in range(200)] + [(7, "http://h1.x/p")] * 2 + [(None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("in_list", F.lit(1)).withColumn("filter_part", F.lit(2))
    universe = op.hosts_without_https(pages)
    want = sorted(op.judge(pages, universe).collect(), key=repr)
    assert sorted(op.judge(pages, universe, most_bits=64).collect(), key=repr) == want and len(want) == 203
    assert Counter(r["verdict"] for r in want) == Counter(op_verdict(rows))
    none = pages.limit(0)
    assert op.judge(none, op.hosts_without_https(none)).count() == 0


# 4 FLAC


def test_flac(docs, rows, none):
    from siftwork.llm import flac as op

    def want(t):
        b = (t or "").encode()
        p = b.ljust(max(192, -(-len(b) // 192) * 192))
        return len(b), p, zlib.crc32(p[-16:])

    out = op.read_back(op.store(docs)).collect()
    assert len(out) == len(rows)
    texts = {d: t for d, t, *_ in rows}
    by_text = {}
    for r in out:
        n, p, _ = want(texts[r["doc_id"]])
        assert (r["n_bytes"], bytes(r["payload"])) == (n, p)
        assert by_text.setdefault(texts[r["doc_id"]] or "", bytes(r["media"])) == bytes(r["media"])
        _, channels = op.decode_stream(bytes(r["media"]))  # the general decoder agrees
        assert bytes(v + 128 for v in channels[0]) == p
    assert op.read_back(op.store(none)).count() == 0
    parts = op.pcm_blocks(op.store(docs.where("doc_id = 7")), blocks=4).orderBy("sample_offset").collect()
    assert b"".join(bytes(r["pcm"]) for r in parts) == want(texts[7])[1] and [r["sample_offset"] for r in parts] == [768 * i for i in range(len(parts))]


def test_flac_damage_shows():
    from siftwork.llm import flac as op

    media = op.encode_batch([op.padded(bytes(range(32, 127)) * 20)])[0]
    for at in range(len(media) - 1, 60, -97):
        bad = bytearray(media)
        bad[at] ^= 0x10
        with pytest.raises(op.FlacError):
            op.decode_batch([bytes(bad)])
    with pytest.raises(op.FlacError):
        op.decode_batch([media[:-30]])


def test_flac_foreign_stream_alone(monkeypatch):
    """A stream that the batched decoder doesn't take goes to the general one without the rest of its batch."""
    from siftwork.llm import flac as op

    texts = [op.padded(b"text %d " % i * (i + 1)) for i in range(40)]
    media = op.encode_batch(texts)
    batched, general, calls = op._decode_own, op.decode_stream, []
    monkeypatch.setattr(op, "_decode_own", lambda streams, infos: None if media[7] in streams or media[30] in streams else batched(streams, infos))
    monkeypatch.setattr(op, "decode_stream", lambda s: calls.append(s) or general(s))
    assert op.decode_batch(media) == texts and sorted(calls) == sorted([media[7], media[30]]) and op.decode_batch([]) == []


def lpc_stream(samples, weights, shift, bits=16):
    """A stereo FLAC stream of one frame with linear predictors, partitions and an escape, written bit by bit."""
    from siftwork.llm import flac as op

    out = []
    put = lambda v, n: out.extend((v >> i) & 1 for i in reversed(range(n)))
    n, order = len(samples[0]), len(weights)
    put(0x3FFE, 14), put(0, 2), put(7, 4), put(0, 4), put(1, 4), put(0, 3), put(0, 1), put(0, 8), put(n - 1, 16)
    pack = lambda: bytes(int("".join(map(str, out[i : i + 8])), 2) for i in range(0, len(out), 8))
    put(op._crc(pack(), op._CRC8_LIST, 8), 8)
    for x in samples:
        put(0, 1), put(31 + order, 6), put(0, 1)
        for v in x[:order]:
            put(v & (1 << bits) - 1, bits)
        put(9, 4), put(shift, 5)
        for w in weights:
            put(w & 1023, 10)
        put(0, 2), put(1, 4)
        residual = [x[i] - (sum(w * x[i - 1 - j] for j, w in enumerate(weights)) >> shift) for i in range(order, n)]
        put(5, 4)
        for r in residual[: n // 2 - order]:
            u = r << 1 if r >= 0 else -r * 2 - 1
            put(0, u >> 5) if u >> 5 else None
            put(1, 1), put(u & 31, 5)
        put(15, 4), put(17, 5)
        for r in residual[n // 2 - order :]:
            put(r & (1 << 17) - 1, 17)
    while len(out) % 8:
        out.append(0)
    frame = pack()
    frame += op._crc(frame, op._CRC16_LIST, 16).to_bytes(2, "big")
    info = n.to_bytes(2, "big") * 2 + bytes(6) + ((44100 << 44) | (1 << 41) | ((bits - 1) << 36) | n).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame


def test_flac_linear_predictors():
    from siftwork.llm import flac as op

    rng = random.Random(3)
    left, right = [0], [5]
    for _ in range(63):
        left.append(max(-3000, min(3000, left[-1] + rng.randrange(-60, 61))))
        right.append(max(-3000, min(3000, right[-1] + rng.randrange(-60, 61))))
    info, channels = op.decode_stream(lpc_stream([left, right], [300, -50], 8))
    assert (info.channels, info.bits, info.samples) == (2, 16, 64) and channels == [left, right]


# 5 licenses


def test_licenses(spark, none):
    from siftwork.llm import licenses as op

    texts = [None, "", "MIT License! mit-license MIT\nLicense", "the apache, license of GNU General Public License v3", "mit licenses", "x " * 40 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the software without restriction", "Licensed under CC BY-NC 4.0.", "license " * 50, "émit license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("labels", F.lit("clash"))
    got = keyed(op.scan_licenses(df), "n_words", "n_base", "first_word", "last_word", "base_labels")
    phrases = [(p.split(), label) for p, label in op.BASE]
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = sorted((k, label) for p, label in phrases for k in range(len(w)) if w[k : k + len(p)] == p)
        assert got[i] == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))
    labels = keyed(op.scan_licenses(df), "labels", "score")
    assert labels[5] == ("mit", 1.0) and labels[6] == ("cc-by-nc", 1.0) and labels[7] == ("", 0.0) and labels[0] == ("", 0.0)
    assert op.scan_licenses(none).count() == 0


def test_licenses_in_one_text(spark):
    """Every notice of a text with many, whole or with words changed, against all alignments of all templates."""
    from siftwork.llm import licenses as op

    notice = {label: [t.text for t in op.TEMPLATES if t.label == label] for label in {t.label for t in op.TEMPLATES}}
    short = notice["cc-by-nc"][0]
    texts = [f"{notice[long][-1]}. then {short}" for long in ("bsd", "isc", "mit", "apache", "mpl")]
    texts += [f"{short} x {notice['isc'][0]} y {notice['unlicense'][0]} z {notice['bsd'][0]}", "\n".join(t.text for t in op.TEMPLATES)]
    r = random.Random(5)
    for _ in range(120):
        parts = []
        for t in r.sample(op.TEMPLATES, r.randint(1, 5)):
            w = t.text.split()
            parts += ["so"] * r.randint(0, 3) + [x if r.random() > r.choice((0, 0.2, 0.45)) else r.choice(("so", "license")) for x in w[r.randint(0, 2) :]]
        texts.append(" ".join(parts))

    def holds(part, phrase):
        return any(part[k : k + len(phrase)] == phrase for k in range(len(part)))

    def brute(w):
        labels = {label for p, label in op.BASE if holds(w, p.split())}
        score = 1.0 if labels else 0.0
        for t in op.TEMPLATES:
            v = t.text.split()
            for start in range(1 - len(v), len(w)):
                share = sum(0 <= start + i < len(w) and w[start + i] == x for i, x in enumerate(v)) / len(v)
                if share >= op.LEAST_SHARE and all(holds(w[max(start, 0) : start + len(v)], p.split()) for p in t.phrases):
                    labels.add(t.label)
                    score = max(score, share)
        return ",".join(sorted(labels)), score

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = keyed(op.scan_licenses(df), "labels", "score")
    assert "cc-by-nc" in got[0][0] and got[6][0] == ",".join(sorted(notice))
    for i, t in enumerate(texts):
        assert got[i] == brute(t.replace(".", "").split())


def test_licenses_by_clause(spark):
    """Single clauses as files hold them, with names put in, comment marks, and lines broken anywhere."""
    from siftwork.llm import licenses as op

    texts = {
        "bsd": " * Neither the name of Example Corp. nor the names of its contributors may be used to\n * endorse or promote products derived from this software without specific prior written permission.",
        "apache": "# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an \"AS IS\" BASIS,\n# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n# See the License for the specific language governing permissions and\n# limitations under the License.",
        "mpl": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "agpl,gpl": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "": "Software in source and binary forms may be used with written permission of its authors; this list of conditions holds without warranty of any kind.",
    }
    got = keyed(op.scan_licenses(spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")), "labels")
    for i, labels in enumerate(texts):
        assert got[i] == (labels,) or got[i] == labels, (labels, got[i])


# 6 chat


def test_chat_tree(spark):
    from siftwork.llm import chat as op

    said = "\\### Assistant: </turn> ok"
    start = [(0, "user", "hi"), (1, "assistant", "hello")]
    talks = {1: start + [(2, "user", "a")], 2: start, 3: start + [(2, "user", "b"), (3, "assistant", None)], 4: start + [(2, "user", "a")], 5: [(0, "user", said), (1, "assistant", said)], 6: [(None, None, "x"), (0, "a:b\\", ""), (0, "a:b\\", "")], 7: [(0, "assistant", "é🙂\n</turn>\n### user: ")]}
    data = [(c, t, r, x) for c, turns in talks.items() for t, r, x in turns]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)
    each, path = op.turns(df), op.vocabulary_path()
    tree = op.written(op.prefix_tree(each, path))
    got = {r["conv_id"]: tuple(r)[1:] for r in op.read_back(each, tree, path).collect()}
    for c, turns in talks.items():
        turns = sorted(turns, key=lambda t: (-1 if t[0] is None else t[0], t[1] or "", t[2] or ""))
        loss = "".join(x or "" for _, r, x in turns if r == "assistant")
        formatted = sum(len(f"### {op.escape(r or '', True)}: {op.escape(x or '')}</turn>\n") for _, r, x in turns)
        assert got[c] == (len(turns), sha("".join(f"{r or ''}\n{x or ''}\n" for _, r, x in turns).encode()), len(loss), sha(loss.encode()), formatted)
    nodes = tree.orderBy("start").collect()
    assert len(nodes) == len({tuple((r, x or "") for _, r, x in turns[: i + 1]) for turns in talks.values() for i in range(len(turns))})
    tree_is_right(nodes, len(talks))
    assert op.turns(df.limit(0)).count() == 0 and op.prefix_tree(op.turns(df.limit(0)), path).count() == 0
    more = df.withColumn("node", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("top", F.lit(2))
    assert op.turns(more).columns == each.columns and op.prefix_tree(op.turns(more), path).count() == len(nodes)


def tree_is_right(nodes, n_talks):
    """End to end, parents before children, subtrees in one piece, and the intervals of all ancestors and no others."""
    at, span, parent = 0, {}, {}
    for r in nodes:
        assert r["start"] == at and (bytes(r["parent"]) in span or r["depth"] == 0)
        at += r["n_tokens"]
        span[bytes(r["node"])], parent[bytes(r["node"])] = (r["start"], at), bytes(r["parent"])
    for r in nodes[:: max(1, len(nodes) // 2000)]:
        above, n = [], bytes(r["node"])
        while n in span:
            above.append(span[n])
            n = parent[n]
        merged = []
        for a, b in reversed(above):
            if merged and merged[-1][1] == a:
                merged[-1][1] = b
            else:
                merged.append([a, b])
        assert [list(i) for i in r["intervals"]] == merged and len(merged) <= 1 + math.log2(n_talks)
        assert r["position"] == sum(b - a for a, b in above[1:])
    stack = []
    for r in nodes:  # depth first
        while stack and stack[-1] != bytes(r["parent"]):
            stack.pop()
        assert stack or r["depth"] == 0
        stack.append(bytes(r["node"]))


def test_chat_deep_conversations(spark):
    """20,000 turns, and others that leave them at many depths: keys and intervals stay short."""
    from siftwork.llm import chat as op

    deep = [("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(20_000)]
    talks = {0: deep, **{k: [*deep[: k * 97], ("user", f"leaves {k}"), ("assistant", "bye")] for k in range(1, 40)}, 50: [*deep[:485], ("user", "leaves 5"), ("assistant", "no")]}
    df = spark.createDataFrame([(c, t, r, x) for c, turns in talks.items() for t, (r, x) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    each, path = op.turns(df), op.vocabulary_path()
    tree = op.written(op.prefix_tree(each, path))
    nodes = tree.drop("tokens").orderBy("start").collect()
    assert len(nodes) == 20_000 + 39 * 2 + 1
    tree_is_right(nodes, len(talks))
    got = {r["conv_id"]: r["turns_sha256"] for r in op.read_back(each, tree, path).collect()}
    assert got == {c: sha("".join(f"{r}\n{x}\n" for r, x in turns).encode()) for c, turns in talks.items()}


def test_chat_escapes():
    from siftwork.llm import chat as op

    rng = random.Random(1)
    for _ in range(300):
        turns = [("".join(rng.choice(["\\", ":", " ", "###", "</turn>", "a"]) for _ in range(4)), "".join(rng.choice(["\\", "### ", "</turn>", "\n", "<", "u: ", "é"]) for _ in range(8))) for _ in range(3)]
        formatted = "".join(f"### {op.escape(r, True)}: {op.escape(t)}</turn>\n" for r, t in turns)
        assert op.parse(formatted) == turns


# 7 line dedup


def brute_lines(rows):
    seen, out = set(), {}
    for d, t, *_ in rows:
        if t is None:
            out[d] = (0, 0, None)
            continue
        x = t.split("\n")
        gone = set()
        for i in range(len(x) - 2):
            k = tuple(x[i : i + 3])
            if not WORD.search("\n".join(k)):
                continue
            if k in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(k)
        out[d] = (len(x), len(gone), "\n".join(v for i, v in enumerate(x) if i not in gone))
    return out


def test_line_dedup(spark, docs, rows, none):
    from siftwork.llm import line_dedup as op

    more = [*rows, (900, "l1\nl2\nl3\nl4", "en", "a", 1), (901, "x\nl1\nl2\nl3\nl4\nl1\nl2\nl3", "en", "a", 1), (902, "\n\n\n\n\n", "en", "a", 5), (903, "\n\n\n\n", "en", "a", 4)]
    df = spark.createDataFrame(more, SCHEMA).withColumn("kept", F.lit("clash"))
    assert keyed(op.dedup_lines(df), "n_lines", "n_removed", "kept") == brute_lines(more)
    assert op.dedup_lines(none).count() == 0


def test_line_dedup_rows_that_share_an_id(spark):
    """Rows of one doc_id keep their own lines; equal rows are one document; rows without doc_id take nothing."""
    from siftwork.llm import line_dedup as op

    data = [(None, "a\nb\nc"), (1, "short"), (1, "x\na\nb\nc"), (2, "a\nb\nc\ny"), (2, "a\nb\nc\ny"), (3, "p\nq\nr"), (3, "0\np\nq\nr")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("doc_id", "text", "1 as covered", "2 as version", "3 as c0", "4 as `left`", "5 as covered_doc", "6 as d")
    out = op.dedup_lines(df)
    got = sorted(((r["doc_id"] or 0, r["text"], r["n_removed"], r["kept"]) for r in out.collect()), key=repr)
    assert out.columns == [*df.columns, "n_lines", "n_removed", "kept"]
    assert [r for r in got if r[0] < 3] == sorted([(0, "a\nb\nc", 0, "a\nb\nc"), (1, "short", 0, "short"), (1, "x\na\nb\nc", 0, "x\na\nb\nc"), *[(2, "a\nb\nc\ny", 3, "y")] * 2], key=repr)
    assert sorted(r[2] for r in got if r[0] == 3) == [0, 3]
    stage = op.line_dedup_stage(spark, df, "")
    assert stage.columns == df.columns and stage.count() == len(data) - sum(r[3] == "" for r in got)


# 8 quality rules


def brute_quality(t):
    w = WORD.findall(t or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality(docs, rows, none):
    from siftwork.llm import quality as op

    df = docs.withColumn("n_words", F.lit("clash"))
    got = keyed(op.score(df), *op.COUNTS, "base_failed")
    assert got == {d: brute_quality(t) for d, t, *_ in rows}
    out = op.score(df).select("kept", "base_failed", "failed").collect()
    assert all(r["kept"] == (not r["failed"] and not r["base_failed"]) for r in out) and any(r["kept"] for r in out)
    assert op.score(none).count() == 0
    only = op.score(docs, (op.Rule("short", "n_words", ">", 3),)).where("kept").count()
    assert only == sum(not brute_quality(t)[5] for _, t, *_ in rows)
    clash = docs.withColumn("quality_lines", F.lit("own")).withColumn("__quality_x", F.lit(3)).withColumn("failed", F.lit(0))
    out = op.score(clash)
    assert set(clash.columns) <= set(out.columns) and {(r["quality_lines"], r["__quality_x"]) for r in out.collect()} == {("own", 3)}
    assert not [c for c in out.columns if c not in clash.columns and c not in (*op.COUNTS, "base_failed", "kept")]


STOPS = set("the of and to in is that for with was a le la les de des du et un une est que der die das und ist von zu ein eine nicht mit el los las y en una por con para es".split())


def brute_failed(t):
    """Names of the production rules that a text fails, without the library."""
    n, chars, symbols, dup, repeated, _ = brute_quality(t)
    w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
    ratio = lambda a, b: a / b if b else 0.0
    stops = sum(re.split("[.,;:!?]", x)[0].translate(LOWER) in STOPS for x in w)
    gaps = " \t\n\x0b\x0c\r"
    bullets = sum(x.lstrip(gaps)[0] in "-*\u2022\u2023\u25e6\u00b7" for x in lines)
    cut = sum(x.rstrip(gaps).endswith(("...", "\u2026")) for x in lines)
    tests = {"few_words": n < 50, "repeated_words": ratio(repeated, n) > 0.5, "short_words": ratio(chars, n) < 2, "long_words": ratio(chars, n) > 20, "symbols": ratio(symbols, n) > 0.2}
    tests |= {"repeated_lines": ratio(dup, len(lines)) > 0.5, "bullets": ratio(bullets, len(lines)) > 0.9, "cut_lines": ratio(cut, len(lines)) > 0.3, "few_stop_words": ratio(stops, n) < 0.02}
    return [k for k, v in tests.items() if v]


def test_quality_rules_by_brute_force(spark, rows, tmp_path):
    """``kept`` and ``failed`` of the production table, on texts around every threshold, by the operator, the query and its SQL."""
    import duckdb

    from siftwork.llm import quality as op
    from siftwork.llm.sql import ORACLES

    r = random.Random(12)
    texts = [t for _, t, *_ in rows]
    for _ in range(400):
        lines = []
        for _ in range(r.randrange(1, 14)):
            w = [r.choice(("The", "OF,", "la;", "x" * r.choice((1, 3, 40)), "#", "a.b", "|", f"w{r.randrange(90)}")) if r.random() < 0.4 else f"word{r.randrange(400)}" for _ in range(r.randrange(1, 18))]
            lines.append(r.choice(("", "", "- ", " \t\u2022", "*", "\u00b7 ")) + " ".join(w) + r.choice(("", "", "", "...", "\u2026 ", "\x0b")))
        texts.append("\n".join(lines + lines[: r.randrange(3)] * r.randrange(2)))
    texts += ["\n".join("- " * (i < k) + f"the item{i} of{i} {i}a {i}b {i}c" for i in range(20)) for k in (17, 18, 19, 20)]
    texts += ["\n".join(f"the item{i} of{i} {i}a {i}b {i}c" + "..." * (i < k) for i in range(20)) for k in (5, 6, 7)]
    texts += ["\n".join("the same" if i < k else f"the item{i} of{i} {i}a {i}b {i}c" for i in range(20)) for k in (10, 11, 12)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: (not brute_failed(t) and not brute_quality(t)[5], ",".join(brute_failed(t))) for i, t in enumerate(texts)}
    assert {x for _, f in want.values() for x in f.split(",")} == {"", *(x.name for x in op.RULES)}
    assert keyed(op.op8_quality_rules(spark, str(tmp_path)), "kept", "failed") == want
    found = duckdb.sql(ORACLES["op8_quality_rules"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")).df()
    assert {i: (bool(k), f) for i, k, f in zip(found.doc_id, found.kept, found.failed, strict=True)} == want


# 9 mixing


def test_mixing(spark, docs, rows, none):
    from siftwork.llm import mixing as op

    got = {r["doc_id"]: r for r in op.mix(docs.withColumn("size", F.lit("clash"))).collect()}
    sizes = {d: len(WORD.findall(t or "")) for d, t, *_ in rows}
    assert {d: r["size"] for d, r in got.items()} == sizes
    order = sorted({s for *_, s, _ in rows if s is not None}) + [None]
    total = {s: sum(sizes[d] for d, _, _, x, _ in rows if x == s) for s in order}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), 1.5 * sum(total.values()), set(order)
    while left > 1e-9 and free:
        share = left / sum(weight[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += share * weight[s]
            if target[s] >= 2 * total[s]:
                left += target[s] - 2 * total[s]
                target[s] = 2.0 * total[s]
                free.discard(s)
    for d, _, _, s, _ in rows:
        assert got[d]["source_size"] == total[s] and got[d]["target"] == pytest.approx(target[s]) and got[d]["taken"] in (0, sizes[d], 2 * sizes[d])
    for s in order:
        taken = sum(got[d]["taken"] for d, _, _, x, _ in rows if x == s)
        assert abs(taken - target[s]) <= max(sizes[d] for d, _, _, x, _ in rows if x == s)
    again = {r["doc_id"]: r["taken"] for r in op.mix(docs.repartition(2)).collect()}
    assert again == {d: r["taken"] for d, r in got.items()}
    more = {r["doc_id"]: r["taken"] for r in op.mix(docs, budget=1.6).collect()}
    assert all(more[d] >= again[d] for d in more)  # thresholds are nested
    assert op.mix(none).count() == 0
    clash = docs.withColumn("__id", F.lit(1)).withColumn("__copies", F.lit(2)).withColumn("taken_id", F.lit(3)).withColumn("c0", F.lit(4))
    mixed = op.mixing_stage(spark, clash, "")
    assert mixed.columns == clash.columns and Counter(r["doc_id"] for r in mixed.collect()) == {d: n // sizes[d] for d, n in again.items() if n}
    empty = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {r["taken"] for r in op.mix(empty).collect()} == {0}


# 10 near duplicates


def brute_near(rows):
    sets = {}
    for d, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def edited(seed, n, base=120, edits=(1, 9)):
    """Copies of one text with a few words changed, many near the similarity from either side, and fresh ones between."""
    rng = random.Random(seed)
    text = [f"b{i}" for i in range(base)]
    out = []
    for d in range(n):
        w = list(text) if d % 5 else [f"u{d}-{i}" for i in range(base)]
        for _ in range(rng.randrange(*edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        out.append((d, " ".join(w)))
    return out


def test_near_duplicates(docs, rows, none):
    from siftwork.llm import near_dedup as op

    assert keyed(op.near_duplicates(docs.withColumn("n_shingles", F.lit("clash"))), "n_shingles", "component_id", "kept") == brute_near(rows)
    assert op.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("seed", "edits"), [(1, (1, 9)), (2, (2, 6))])
def test_near_duplicates_around_a_base(spark, seed, edits):
    from siftwork.llm import near_dedup as op

    data = edited(seed, 90, edits=edits)
    got = keyed(op.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")), "n_shingles", "component_id", "kept")
    assert got == brute_near(data)


def template_pages(n, own=24, seed=1):
    """Pages of 80 common words and ``own`` of their own: at 24 their similarity is 0.61, so they share tables and have no links."""
    return [(d, " ".join([f"c{i}" for i in range(80)] + [f"o{d}-{i}" for i in range(own)])) for d in range(n)]


def test_pages_of_a_template_meet_nowhere(spark, monkeypatch):
    """The search beyond the tables forms no pairs of pages that share a template, and still finds the links among them."""
    from siftwork.llm import near_dedup as op

    formed, met = [], op._met

    def counted(*args):
        out = op.written(met(*args))
        formed.append(out.count())
        return out

    monkeypatch.setattr(op, "_met", counted)
    data = template_pages(400)
    w = data[7][1].split()
    data += [(1000 + k, " ".join([*w[: 60 + 5 * k], "edited", *w[61 + 5 * k :]])) for k in range(5)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = keyed(op.near_duplicates(df), "component_id", "kept")
    assert got == {d: (7, False) if d >= 1000 else (d, True) for d, _ in data}
    assert sum(formed) <= 20 * len(data)


def test_near_duplicates_rows_that_share_an_id(spark):
    from siftwork.llm import near_dedup as op

    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    df = spark.createDataFrame([(1, a), (2, a), (2, a), (3, b), (3, a + " x"), (4, b)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in op.near_duplicates(df).collect())
    assert got == [(1, 56, 1), (2, 56, 1), (2, 56, 1), (3, 56, 1), (3, 57, 1), (4, 56, 1)]


# rows without ids


def test_rows_without_ids(spark):
    import corpus_pipeline
    from siftwork.llm import byte_bpe, flac, licenses, line_dedup, mixing, near_dedup, quality, substring_dedup

    text = "\n".join(" ".join(f"the-{i}-{j}" for j in range(20)) for i in range(5)) + " the end of all that is"
    data = [(None, text, None, None, None), (1, text, None, "a", None), (2, text, "en", "a", 3), (None, None, None, None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    path = byte_bpe.vocabulary_path()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.dedup(df).collect()) == [(0, 0), (0, 0), (1, 0), (2, 106)]
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in near_dedup.near_duplicates(df).collect()) == [(0, True), (0, True), (1, True), (2, False)]
    for out in (byte_bpe.decode(byte_bpe.encode(df, path), path), flac.read_back(flac.store(df)), licenses.scan_licenses(df), line_dedup.dedup_lines(df), quality.score(df), mixing.mix(df)):
        assert out.count() == 4
    left = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, "")
        assert left.columns == df.columns
    assert left.where("doc_id is null").count() > 0


def test_stop_words(spark):
    from siftwork.llm import quality as op

    keys = " ".join(f"key{i}" for i in range(10_000))
    texts = [keys, f"{keys} in more", *("\n".join(f"The {i}a, word{i} {i}b." + " of" * (i % n == 0) for i in range(60)) for n in (1, 2, 3)), "the, LA.x thee of;of a\tUND! ofx"]
    texts += [" ".join(["the" if i % n == 0 else f"w{i}" for i in range(200)]) for n in (40, 50, 51, 199)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = keyed(op.score(df), "kept", "failed")
    for i, t in enumerate(texts):
        assert got[i][1] == brute_failed(t)
    assert got[1] == (False, ["few_stop_words"]) and got[2][0]


def test_a_very_long_text_is_judged_by_ratios(spark):
    from siftwork.llm import quality as op

    text = " ".join("the" if i % 9 == 0 else f"w{i}" for i in range(1_000_020))
    got = op.score(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got["n_words"], got["kept"], got["failed"]) == (1_000_020, True, [])


# pipeline


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    data = [(d, t, lang, s, n) for d, t, lang, s, n in corpus(8, 120)]
    data = [(d, t and t + (" the end of it all " + " ".join(f"z{d}-{i}" for i in range(50))) * (d % 3 > 0), lang, s, n) for d, t, lang, s, n in data]
    data = [(d, t, lang, s, len(t or "")) for d, t, lang, s, n in data]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, docs
    expected = [r for r in data if not brute_failed(r[1]) and not brute_quality(r[1])[5]]
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, left, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            out = spark.createDataFrame(out.collect(), SCHEMA)
            left = out
        steps.append(sorted(tuple(r) for r in out.collect()))
    assert [r[0] for r in steps[0]] == [r[0] for r in expected]
    lines = brute_lines(expected)
    expected = [(d, lines[d][2] if lines[d][1] else t, lang, s, len(lines[d][2]) if lines[d][1] else n) for d, t, lang, s, n in expected]
    expected = [r for r in expected if WORD.search(r[1])]
    assert steps[1] == expected
    near = brute_near(expected)
    expected = [r for r in expected if near[r[0]][2]]
    assert steps[2] == expected
    copies = Counter(r[0] for r in steps[3])
    assert set(copies) <= {r[0] for r in expected} and set(copies.values()) <= {1, 2}
    enc = reference_encoding()
    want = sorted((d, len(enc.encode_ordinary(t)), sha(t.encode())) for d, t, *_ in expected for _ in range(copies[d]))
    assert sorted((r[0], r[1], r[3]) for r in steps[4]) == want
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(want)


def test_sql(spark):
    import sys

    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0] + "/tests")
    from test_queries import same

    from siftwork.llm import registry

    for name, sql in registry.oracle_sql().items():
        same(spark, name, registry.queries()[name], sql)


# clashing columns, repeated rows, long texts


#: Names that operators use for columns of their own, as far as documents may have them.
CLASHING = ("anchor", "at", "below", "bits", "bucket", "copies", "count", "decoded", "digest", "first", "hash", "ids", "key", "kept", "labels", "line", "media", "n", "n_removed", "n_shingles", "n_words", "part", "payload", "place", "pos", "row", "score", "short", "size", "target", "window", "words", "__row", "__all")


@pytest.fixture(scope="module")
def odd(spark):
    """(rows, table, table with clashing columns): rows twice, ties, and a text of more than a megabyte."""
    rng = random.Random(9)
    long = " ".join(f"{rng.choice(('the', 'of', 'w'))}{rng.randrange(4000)}" + "\n" * (i % 12 == 0) for i in range(180_000))
    rows = corpus(9, 40)
    rows += [rows[12], rows[12], rows[20], (500, long, "en", "a", len(long)), (501, long, "en", "b", len(long)), (502, None, None, None, None), (502, None, None, None, None)]
    plain = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return rows, plain, plain.withColumns({c: F.lit(f"clash {c}") for c in CLASHING})


def operators():
    from siftwork.llm import byte_bpe, flac, licenses, line_dedup, mixing, near_dedup, quality, substring_dedup

    path = byte_bpe.vocabulary_path()
    return {
        "dedup": (substring_dedup.dedup, ("n_words", "n_removed", "kept_sha256")),
        "bpe": (lambda d: byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(d, path), path)), ("n_tokens", "ids_sha256", "decoded_sha256")),
        "flac": (lambda d: flac.read_back(flac.store(d)), ("n_bytes", "payload", "media")),
        "licenses": (licenses.scan_licenses, ("n_words", "n_base", "labels", "score")),
        "lines": (line_dedup.dedup_lines, ("n_lines", "n_removed")),
        "quality": (quality.score, ("n_words", "kept", "failed")),
        "mixing": (mixing.mix, ("size", "target", "taken")),
        "near": (near_dedup.near_duplicates, ("n_shingles", "component_id", "kept")),
    }


@pytest.mark.parametrize("name", ["dedup", "bpe", "flac", "licenses", "lines", "quality", "mixing", "near"])
def test_clashing_columns_repeated_rows_and_long_texts(odd, name):
    rows, plain, clash = odd
    op, columns = operators()[name]
    read = lambda df: sorted(((r["doc_id"], *(r[c] for c in columns)) for r in op(df).collect()), key=repr)
    got = read(plain)
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=repr)
    some = "true" if name == "mixing" else "doc_id < 500"  # the long texts share nothing with the others
    assert [r for r in got if r[0] < 500 or name == "mixing"] == read(clash.where(some))
    out, text = {r[0]: r[1:] for r in got}, next(t for d, t, *_ in rows if d == 500)
    n, data = len(WORD.findall(text)), text.encode()
    if name == "dedup":
        assert out[501] == (n, n, sha(b""))
    elif name == "bpe":
        assert out[500] == out[501] and out[500][2] == sha(data)
    elif name == "flac":
        assert out[500] == out[501] and out[500][0] == len(data) > 1_000_000 and bytes(out[500][1]).rstrip(b" ") == data.rstrip(b" ")
    elif name == "lines":
        assert out[500][1] == 0 and out[501][1] >= n // 12
    elif name == "near":
        assert (out[500][1:], out[501][1:]) == ((500, True), (500, False))
    else:
        assert out[500][0] == n
