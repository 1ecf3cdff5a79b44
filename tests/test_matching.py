"""Notes matched with documents, against all pairs."""

import random
import re

from contrapunto.operators import matching as M


def windows(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {" ".join(words[i:i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


def brute(notes, docs, least):
    out = {}
    for note, process, text in notes:
        own, best = windows(text), (None, None)
        for doc, p, name, body in docs:
            for field, t in (("nombre", name), ("texto", body)):
                other = windows(t)
                if p == process and own and other and len(own & other) >= least * min(len(own), len(other)):
                    best = min([x for x in (best, (-len(own & other) / min(len(own), len(other)), doc, field)) if x[0] is not None])
        out[note] = best[1:] if best[0] is not None else (None, None)
    return out


def run(spark, notes, docs, least=0.5):
    got = M.match_notes(spark.createDataFrame(notes, "note_id string, process_id string, text string"),
                        spark.createDataFrame(docs, "doc_id long, process_id string, nombre string, texto string"), least).collect()
    assert len(got) == len(notes)
    return {r["note_id"]: (r["doc_id"], r["campo"]) for r in got}


def test_every_note_over_whole_texts(spark):
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefghij") + rng.choice("aeiou") + rng.choice("lmnrst")
    docs = [(d, f"P{d % 3}", f"{word()} {word()} {d}.pdf", " ".join(word() for _ in range(rng.randint(0, 300)))) for d in range(60)]
    notes = [(f"n{k}", f"P{k % 4}", " ".join(word() for _ in range(rng.randint(0, 40)))) for k in range(60)]
    for d, p, name, text in docs[::2]:  # quotes from the end of the text, in part changed
        tail = text.split()[-30:]
        notes.append((f"q{d}", p, " ".join(w if rng.random() < 0.8 else "zz" for w in tail)))
        notes.append((f"m{d}", p, f"falta {name} desde ayer"))
    notes += [("nulo", "P0", None), ("vacio", "P0", " ,"), ("solo", "P1", "palabra")]
    for least in (0.5, 0.3, 1.0):
        want = brute(notes, docs, least)
        assert run(spark, notes, docs, least) == want
        assert sum(d is not None for d, _ in want.values()) >= 30


def test_copies_are_compared_once(spark):
    text = "el mismo texto en todos los documentos del proceso"
    docs = [(d, "P1", None, text) for d in range(50, 0, -1)] + [(0, "P2", "otro", text)]
    notes = [(f"n{k}", "P1", f"dice: {text}") for k in range(40)]
    got = run(spark, notes, docs)
    assert set(got.values()) == {(1, "texto")}
    sets = M.with_windows(spark.createDataFrame(notes, "note_id string, process_id string, text string"), "text")
    assert M._classes(sets).count() == 1


def test_rounds_keep_the_best_document(spark):
    base = [f"w{k}" for k in range(20)]
    docs = [(9, "P1", None, " ".join(base)), (4, "P1", None, " ".join(base[:12] + ["x"] * 1 + base[13:])), (2, "P1", None, " ".join(base[:13] + ["y"] * 9))]
    notes = [("whole", "P1", " ".join(base)), ("part", "P1", " ".join(base[:16] + ["p", "q", "r"])), ("less", "P1", " ".join(base[:11] + list("abcdefgh")))]
    for least in (0.5, 0.6, 0.9):
        assert run(spark, notes, docs, least) == brute(notes, docs, least)
    own = M.with_windows(spark.createDataFrame(notes[:1], "note_id string, process_id string, text string"), "text")
    bodies = M.with_windows(spark.createDataFrame(docs, "doc_id long, process_id string, campo string, text string"), "text")
    assert M.overlap_pairs(M._classes(own), M._classes(bodies), 1.0).count() == 1
    member = bodies.groupBy("process_id", bodies.klass.alias("other")).agg({"doc_id": "min"}).selectExpr("process_id", "other", "struct(`min(doc_id)` doc_id, 'texto' campo) doc")
    assert [r["best"]["doc_id"] for r in M.best_overlaps(M._classes(own), M._classes(bodies), member, 0.5).collect()] == [9]


def test_only_heads_and_what_they_ask_for_are_dealt(spark):  # F2
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randint(0, 99999)}" for _ in range(n))
    sets = lambda rows: M.with_windows(spark.createDataFrame(rows, "process_id string, text string"), "text")
    own, bodies = sets([("P1", text(100)) for _ in range(20)] + [(None, "a b")]), sets([("P1", text(2000)) for _ in range(10)])
    ranks = M.frequencies([own, bodies])
    heads = M._rows(own, ranks, 1.0)
    assert heads.count() == 20 * (1 + M.MORE) and heads.where("need <> 1 + 2").isEmpty()
    asked = M._rows(bodies, ranks, 1.0, M._bitmap(own), M._bitmap(heads.selectExpr("process_id", "array(w) wins")))
    assert asked.count() < 200  # of 20,000 windows
    same = sets([("P1", "a b, A"), ("P2", "a b a"), ("P1", "ab a")]).collect()
    assert same[0]["klass"] == same[1]["klass"] != same[2]["klass"] and [r["n"] for r in same] == [2, 2, 1]
