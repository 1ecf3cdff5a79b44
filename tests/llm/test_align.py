"""Alignment of two tokenizers against set arithmetic on their ends, and the public tokenizer libraries."""

import collections
import hashlib
import random

import pytest
import sentencepiece
from tokenizers import Tokenizer

from contrapunto.llm import align
from contrapunto.llm.queries import QUERIES, tokenizer_pair


@pytest.fixture(scope="module")
def public():
    """Plain encoders and token bytes, straight from the files."""
    a_path, _, b_path = tokenizer_pair()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    sign = {s: v for s, v in align._byte_of().items()}
    raw_a = lambda i: bytes(sign[c] for c in a.id_to_token(i))
    raw_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, raw_a, raw_b


def brute(public, rows):
    a, b, raw_a, raw_b = public
    linked, out = collections.Counter(), []
    for i, text in rows:
        ia = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ta, tb = [raw_a(x) for x in ia], [raw_b(x) for x in ib]
        if not text or b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
            out.append((i, [], [], []))
            continue
        ends = [[sum(map(len, t[:k + 1])) for k in range(len(t))] if len(t) < 300 else [] for t in (ta, tb)]
        for own, t in zip(ends, (ta, tb)):
            if not own:
                for x in t:
                    own.append(len(x) + (own[-1] if own else 0))
        cuts = sorted(set(ends[0]) & set(ends[1]))
        made = []
        for low, high in zip([0, *cuts], cuts):
            made.append(([x for x, e in zip(ia, ends[0]) if low < e <= high] if len(ia) < 3000 else None, [x for x, e in zip(ib, ends[1]) if low < e <= high] if len(ib) < 3000 else None))
        if len(ia) >= 3000 or len(ib) >= 3000:
            at = [{e: k + 1 for k, e in enumerate(own)} for own in ends]
            made = [(ia[at[0].get(low, 0):at[0][high]], ib[at[1].get(low, 0):at[1][high]]) for low, high in zip([0, *cuts], cuts)]
        linked.update({(x, y) for g in made for x in g[0] for y in g[1]})
        out.append((i, ia, ib, made))
    top = collections.defaultdict(int)
    for (x, _), n in linked.items():
        top[x] = max(top[x], n)
    rows = []
    for i, ia, ib, made in out:
        counts = [(x, linked[x, y]) for g in made for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in made)
        rows.append((i, len(ia), len(ib), len(made), len(counts), sum(n == top[x] for x, n in counts), sum(n for _, n in counts), hashlib.sha256(text.encode()).hexdigest() if ia else ""))
    return collections.Counter(rows)


def counted(df):
    return collections.Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_whole_table(spark, public, data_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = counted(QUERIES["op13_token_alignment"](spark, data_dir))
    assert got == brute(public, rows) and sum(r[3] > 0 for r in got) > 100


def test_odd_rows(spark, public, docs, odd):
    rows = list(odd) + [(30, "<|endoftext|> </s><s> <0x41>"), (31, "▁ tells them apart"), (32, "  two  blanks "), (33, "ﬁ ① \u0000 　x"), (34, "\U0001f9d1‍\U0001f680 漢字 ภาษาไทย"), (35, "=" * 5000), (35, "ab" * 3000), (None, "no id")]
    table = docs(rows).withColumnRenamed("fp", "chunk").withColumnRenamed("key", "pos")
    for size in (align.CHUNK, 40):  # the small one makes many chunks
        assert counted(align.alignment(table, *tokenizer_pair(), chunk_bytes=size)) == brute(public, rows)
    assert align.alignment(docs([]), *tokenizer_pair()).count() == 0
    one = {r["doc_id"]: r for r in align.groups(docs([(1, "a plain text"), (2, None)]), *tokenizer_pair()).collect()}
    assert one[2]["a"] == [] and one[2]["groups"] == [] and one[1]["groups"][0]["a_from"] == 0 and one[1]["groups"][-1]["b_to"] == len(one[1]["b"])
    pairs = align.translation(docs([(1, "a plain text"), (2, "a plain text"), (3, "plain")]), *tokenizer_pair()).collect()
    assert max(r["n"] for r in pairs) == 3 and all(r["best"] for r in pairs if r["n"] == 3)


def test_segments_find_all_common_ends():
    rng = random.Random(8)
    for _ in range(400):
        last = rng.randint(1, 120)
        a, b = (sorted({*rng.sample(range(1, last + 1), rng.randint(0, last - 1)), last}) for _ in range(2))
        if rng.random() < 0.5:  # long one-to-one stretches with a shift between them
            b = sorted(set(a[:40]) | set(b[40:]) | {last})
        made, at = [], (0, 0)
        sizes = [bytes(y - x for x, y in zip([0, *own], own)) for own in (a, b)]
        for i, i2, j, j2, single in align.segments(*sizes):
            assert (i, j) == at and (not single or i2 - i == j2 - j)
            made += a[i:i2] if single else [a[i2 - 1]]
            at = (i2, j2)
        assert at == (len(a), len(b)) and made == sorted(set(a) & set(b))
    assert align.segments(b"", b"") == []


def test_wide_groups_are_counted():
    a, b = [1, 2, 1] * 40, [7, 8] * 60
    keys, times, groups, links = align.links(a, b, [(0, 120, 0, 120, False)])
    assert groups == 1 and links == 120 * 120
    assert dict(zip(keys.tolist(), times.tolist())) == {x << 32 | y: n * 60 for x, n in ((1, 80), (2, 40)) for y in (7, 8)}


def test_both_encoders_of_a_agree(public):
    """The ranks taken from the file give the ids of the file's own library, beside every kind of sign."""
    pair, a = align.Pair.of(*tokenizer_pair()), public[0]
    rng = random.Random(2)
    some = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000] + rng.sample(range(0xE000, 0x110000), 3000)
    texts = [f" the{chr(c)}the 12{chr(c)}34 !{chr(c)}! {chr(c)} {chr(c)}{chr(c)}x'll" for c in some]
    assert [pair.fast_a.encode_ordinary(t) for t in texts] == [e.ids for e in a.encode_batch(texts, add_special_tokens=False)]
    long = "word 12, " * 150_000
    assert pair._encode_a(long) == pair.fast_a.encode_ordinary(long)
