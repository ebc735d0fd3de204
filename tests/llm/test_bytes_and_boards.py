"""Byte BPE, alignment and the leaderboard feed against brute force, and the cases each must define."""

from __future__ import annotations

import datetime
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from promptmatrix.llm import alignment, byte_bpe, leaderboard

TEXTS = [
    None, "", " ", "\n", "  two  spaces ", "It's we'll I'M", "<|endoftext|> </s> <s>x", "▁x", "a  b\n\n c\x00\x1f é漢字 👍🏽", "x " * 40, "word " * 9000 + "▁", "漢" * 3000 + " end",
    "word " * 9000, "aaaaaaaaaaaaaaaaaaaaaaaa", "same", "same", "\t\t \r\n1234567 + 89", "Größe ЖжЖ ελ 東京 " * 5, "a" * 20000,
]


@pytest.fixture(scope="module")
def words():
    return byte_bpe.load()


@pytest.fixture(scope="module")
def library(words):
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks={t.encode("latin-1"): n for t, n in words.rank.items()}, special_tokens={})


@pytest.fixture(scope="module")
def texts(spark):
    extra = [(i, t, 7, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", 7, "x"), (3, "again", 7, "x")]
    return spark.createDataFrame(extra, "doc_id long, text string, ids int, pair string")


def test_byte_bpe_equals_the_library(texts, words, library):
    got = Counter(tuple(r) for r in byte_bpe.digests(texts, words).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    want: Counter = Counter()
    for d, t, *_ in texts.collect():
        ids = library.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    assert byte_bpe.digests(texts.limit(0), words).collect() == []


def test_decode_of_odd_ids(spark, words):
    rows = spark.createDataFrame([(1, [72, None, -4, 99999999]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [bytes(r["decoded"]) for r in byte_bpe.decode(rows, words).orderBy("doc_id").collect()] == [words.raw[72], b"", b""]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aabcde thé ’s'\n\t12漢👍"), max_size=60), st.data())
def test_prefixes_grow_and_change(words_and_library, text, data):
    coder, library = words_and_library
    assert [i for part in coder.ids(text) for i in part] == library.encode_ordinary(text)
    piece = text.encode().decode("latin-1")
    whole = byte_bpe.Prefixes(coder, piece)
    assert whole.ids() == [coder.rank[p] for p in byte_bpe.merged(piece, coder.rank)[0]]
    cut = data.draw(st.integers(0, len(piece)))
    assert byte_bpe.Prefixes(coder, piece[:cut]).append(piece[cut:]).last == whole.last
    removed, put = data.draw(st.integers(0, len(piece) - cut)), data.draw(st.sampled_from(["", "x", " the", "ing"]))
    whole.edit(cut, removed, put)
    assert whole.last == byte_bpe.Prefixes(coder, piece[:cut] + put + piece[cut + removed :]).last


@pytest.fixture(scope="module")
def words_and_library(words, library):
    return byte_bpe.Coder(words), library


def test_edit_stops_near_the_change(words):
    coder = byte_bpe.Coder(words)
    p = byte_bpe.Prefixes(coder, "the quick brown fox jumps over the lazy dog " * 400)
    assert p.edit(50, 3, "cat") < 1000


def aligned(rows: list[tuple]) -> Counter:
    """Brute force: token by token, with the libraries' own encoders."""
    one = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    of = alignment.byte_of_character()
    counts: Counter = Counter()
    found = []
    for d, text in rows:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        raw_a = [bytes(of[c] for c in one.id_to_token(i)) for i in a]
        raw_b = [bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [two.id_to_piece(i)]]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            found.append((d, 0, 0, "", []))
            continue
        end_a, end_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        at = dict(zip(end_b, b, strict=True))
        links = [(x, at[e]) for e, x in zip(end_a, a, strict=True) if e in at]
        groups, i, j = [], 0, 0
        for cut in sorted(set(end_a) & set(end_b)):
            k, m = end_a.index(cut, i) + 1, end_b.index(cut, j) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        counts.update(links)
        found.append((d, len(a), len(b), hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
    best: dict[int, int] = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    return Counter((d, n, m, len(x), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), sha) for d, n, m, sha, x in found)


@pytest.mark.parametrize("hot", [1 << 18, 20])
def test_alignment_equals_brute_force(texts, hot):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in alignment.align(texts, hot=hot).select(names).collect()) == aligned([(r[0], r[1]) for r in texts.collect()])
    assert alignment.align(texts.limit(0)).collect() == []


def test_alignment_of_slices(monkeypatch):
    both = alignment.Aligner(alignment.ByteSide("/opt/tokenizers/byte_bpe_50k.json"), alignment.PieceSide("/opt/tokenizers/piece_bpe_32k.model"))
    whole = list(both.documents(TEXTS))
    monkeypatch.setattr(alignment, "BLOCK", 50)
    for x, y in zip(both.documents(TEXTS), whole, strict=True):
        assert x[:4] == y[:4] and x[4].tolist() == y[4].tolist() and x[5].tolist() == y[5].tolist()


def test_end_marks():
    rng = np.random.default_rng(5)
    places = np.sort(rng.choice(1000, 200, replace=False))
    ends = alignment.Ends.at(places, 1000)
    assert ends.select().tolist() == places.tolist()
    assert ends.rank(np.arange(1000)).tolist() == [int((places <= i).sum()) for i in range(1000)]


LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"


def shop(seed: int) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Lines with nulls, repeats, ties, a hot item, late days and refunds."""
    rng = random.Random(seed)
    items = [(i, rng.choice([None, 0.005 * rng.randint(1, 4000)])) for i in range(60)]
    vendors = [(v, None if v == 7 else v % 3) for v in range(9)]
    lines = []
    for s in range(1500):
        item = None if rng.random() < 0.02 else 5 if rng.random() < 0.3 else rng.randrange(64)
        day = None if rng.random() < 0.05 else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=rng.randrange(150), hours=rng.randrange(24))
        lines.append((None if rng.random() < 0.02 else s, rng.randint(1, 3), item, None if rng.random() < 0.02 else rng.randrange(11), rng.choice([None, 1, 2]), rng.choice([None, 10.0, 10.0, 0.285, -3.5, rng.uniform(0, 90)]), 0.0, rng.choice(["kept", "swapped", None, "returned"]), day))
    return lines + lines[:40], items, vendors


def feed(lines: list[tuple], items: list[tuple], vendors: list[tuple]) -> Counter:
    """Brute force: one line after another, all boards anew each day."""
    price, nation = dict(items), dict(vendors)
    batches: dict[int, list] = defaultdict(list)
    for sale, line, item, vendor, quantity, amount, _, flag, shipped in lines:
        h = zlib.crc32(",".join("" if x is None else str(x) for x in (sale, item, vendor, line)).encode())
        s = (shipped.date() - datetime.date(1970, 1, 1)).days if shipped else 19723 + h % 150
        a = s + h % 7 + (20 if h % 5 == 0 else 0)
        x = math.floor(100 * amount + 0.5) if amount is not None else quantity * math.floor(100 * price[item] + 0.5) if quantity is not None and price.get(item) is not None else 0
        batches[min(8, 1 + (a - 19723) * 8 // 180)].append((a, s, nation.get(vendor) if item in price else None, item, -x if flag == "swapped" else x))
    revenue: dict = defaultdict(int)
    board: dict = {}
    latest, out = -1, Counter()
    for b in sorted(batches):
        for day in sorted({r[0] for r in batches[b]}):
            for _, s, n, item, x in (r for r in batches[b] if r[0] == day):
                if n is not None and s + 15 >= latest:
                    revenue[n, item] += x
            for n in {k[0] for k in revenue}:
                new = {i: k for k, (_, i) in enumerate(sorted((-x, i) for (m, i), x in revenue.items() if m == n and x > 0)[:10], 1)}
                old = board.get(n, {})
                for i in old.keys() | new.keys():
                    if old.get(i) != new.get(i):
                        out[n, day, i, b, "enter" if i not in old else "exit" if i not in new else "move", old.get(i), new.get(i), revenue[n, i]] += 1
                board[n] = new
        latest = max(latest, max(r[1] for r in batches[b]))
    return out


@pytest.mark.parametrize("shards,fan", [(3, 256), (3, 2)])
def test_feed_equals_brute_force(spark, monkeypatch, shards, fan):
    lines, items, vendors = shop(shards)
    monkeypatch.setattr(leaderboard, "FAN", fan)
    if fan == 2:  # one more level of merges; fewer starts
        lines = [x for x in lines if x[-1] is not None and x[-1] < datetime.datetime(2024, 1, 25)]
    clash = {"shard": F.lit(1), "cents": F.lit(2), "batch": F.lit(3)}
    got = leaderboard.run(spark.createDataFrame(lines, LINES).withColumns(clash), spark.createDataFrame([*items, (None, 1.0)], "item_id long, price double").withColumns(clash), spark.createDataFrame([*vendors, (None, 1)], "vendor_id long, nation_id int").withColumns(clash), shards)
    names = ["nation_id", "arrival_day", "item_id", "batch", "change", "old_rank", "new_rank", "revenue"]
    assert Counter(tuple(r) for r in got.select(names).collect()) == feed(lines, items, vendors)


def test_feed_of_nothing(spark):
    none = leaderboard.run(spark.createDataFrame([], LINES), spark.createDataFrame([], "item_id long, price double"), spark.createDataFrame([], "vendor_id long, nation_id int"))
    assert none.collect() == [] and "batch" in none.columns


def test_bands_are_ordered():
    bands = [leaderboard.band(c) for c in range(1, 5000)]
    assert bands == sorted(bands) and len(set(bands)) > 12
