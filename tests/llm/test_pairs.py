"""Near-sameness, cross-split overlaps, repeated feedback and leaks against brute force."""

import json
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import history, leaks, overlap, store, wording


def voc(rng, n=4000):
    return ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(n)]


def edited(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(out)), int(len(out) * share)):
        out[i] = rng.choice(["", "zz" + str(rng.randint(0, 99)), out[i] + " qq"])
    return [w for w in out if w]


def dressed(rng, text):
    """The same wording, written differently."""
    k = rng.randint(0, 5)
    if k == 0:
        return text.upper().replace(" ", "  ")
    if k == 1:
        return json.dumps({"x": text}, ensure_ascii=True)
    if k == 2:
        return text.replace(" ", "&#32;", 2).replace("a", "&#97;", 1)
    if k == 3:
        return "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in text)
    if k == 4:
        return f"<b>{text[:10]}</b>{text[10:]}" + "​."
    return f"**{text}**"


def test_words_and_distance():
    assert wording.words('{"b": "Two  TWO", "a": "One&nbsp;x"}') == [["one", "x"], ["two", "two"]]
    assert wording.words("ＡＢＣ, déjà​-vu “<i>ok</i>”") == [["abc", "déjà", "vu", "ok"]]
    assert wording.words(None) == wording.words("") == wording.words(" .,; ") == wording.words("{}") == []
    assert wording.words('{"a": ') == [["a"]]
    rng = random.Random(2)
    for _ in range(300):
        a = np.array([rng.randint(0, 5) for _ in range(rng.randint(0, 25))], np.int64)
        b = np.array([rng.randint(0, 5) for _ in range(rng.randint(0, 25))], np.int64)
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            e = [i]
            for j, y in enumerate(b, 1):
                e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
            d = e
        assert wording.distance(a, b, 100) == d[-1]
        assert (wording.distance(a, b, 4) <= 4) == (d[-1] <= 4)


def parts(text):
    return [wording.hashes(w) for w in wording.words(text)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    v = voc(rng)
    stock = [" ".join(rng.choices(v, k=40)) for _ in range(3)]
    rows = []
    for i in range(500):
        words = rng.choices(v, k=rng.choice([9, 15, 30, 60, 90]))
        text = " ".join(words)
        if i % 3 == 0:
            text = stock[i % 2] + " " + text
        rows.append((f"r-{i}", rng.random() < 0.3, text))
    for i in range(200):
        src = rng.choice(rows)
        rows.append((f"n-{i}", rng.random() < 0.5, dressed(rng, " ".join(edited(rng, src[2].split(), rng.choice([0, 0.03, 0.1, 0.3]))))))
    base = rng.choices(v, k=80)
    for i in range(120):  # a cluster of near copies
        rows.append((f"c-{i}", i % 2 == 0, " ".join(edited(rng, base, 0.04))))
    rows += [
        ("x-1", True, None), ("x-2", False, None), ("x-3", True, ""), ("x-4", False, ""), ("x-5", True, "…"), rows[0], rows[501],
        ("y-1", True, "abc def"), ("y-2", False, "ABC, def!")
    ]
    return rows


def test_overlaps_are_those_of_brute_force(spark, corpus):
    df = spark.createDataFrame(corpus, "id string, ev boolean, text string")
    got = {tuple(r) for r in overlap.near_same_across(df).collect()}
    p = {(i, e): parts(t) for i, e, t in corpus if parts(t)}
    ids = sorted(p)
    bags = {k: set(np.concatenate(v).tolist()) for k, v in p.items()}
    want = set()
    for a in ids:
        if a[1]:
            for b in ids:
                if not b[1] and len(bags[a] & bags[b]) * 2 >= min(len(bags[a]), len(bags[b])) and wording.near_same(p[a], p[b]):
                    want.add((a[0], b[0]))
    assert want - got == set() and got == want and len(want) > 3000


def test_overlaps_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, ev boolean, text string")
    assert overlap.near_same_across(empty).count() == 0
    one = spark.createDataFrame([("a", True, "x y z"), ("b", None, "x y z"), (None, False, "x y z")], "id string, ev boolean, text string")
    assert overlap.near_same_across(one).count() == 0


def test_hot_starts_are_routed(spark, monkeypatch):
    """Boilerplate that most records begin with goes to the joins on longer prefixes and costs no pair."""
    rng = random.Random(8)
    v = voc(rng)
    stock = " ".join(rng.choices(v, k=20))
    rows = [(f"r-{i}", i % 4 == 0, stock + " " + " ".join(rng.choices(v, k=rng.randint(30, 50)))) for i in range(200)]
    rows += [(f"n-{i}", i % 4 != 0, " ".join(edited(rng, rows[i][2].split(), 0.05))) for i in range(100)]
    df = spark.createDataFrame(rows, "id string, ev boolean, text string")
    usual = {tuple(r) for r in overlap.near_same_across(df).collect()}
    monkeypatch.setattr(overlap, "HOT_LEAST", 50)
    monkeypatch.setattr(overlap, "GROUP", 4)
    routed = []
    real = overlap.bags.possible_pairs
    monkeypatch.setattr(overlap.bags, "possible_pairs", lambda *a: (routed.append(1), real(*a))[1])
    assert {tuple(r) for r in overlap.near_same_across(df).collect()} == usual and len(usual) >= 95 and routed


def feedback_rows(rng):
    v = voc(rng)
    questions = [
        ("noul", "Is it so?", None, None), ("choice", "Which one?", ["a b", "c"], None), ("choice", "which  ONE", ["C", "A b"], None),
        ("score", "How good?", None, ["1", "2"]), None
    ]
    rows = []
    for i in range(400):
        if rows and rng.random() < 0.4:
            old = rng.choice(rows)
            state, sha = old[5], old[6]
            if state and rng.random() < 0.8:
                state = dressed(rng, " ".join(edited(rng, " ".join(w for p in wording.words(state) for w in p).split(), rng.choice([0, 0.05, 0.3]))))
                sha = f"{rng.getrandbits(256):064x}"
            elif rng.random() < 0.5:
                state, sha = rng.choice([None, '{"note": "<redacted>"}']), (sha or "").upper() or None
            q = old[4]
        else:
            state, sha, q = " ".join(rng.choices(v, k=rng.choice([5, 20, 60]))), f"{rng.getrandbits(256):064x}", rng.choice(questions)
        rows.append((f"f-{i}", rng.randint(1, 6), rng.choice(["confirmed", "confirmed", "pending", None]), None, q, state, sha))
    rows += [("f-x", None, "confirmed", None, questions[0], "a b c", None), ("f-y", 3, "confirmed", None, questions[0], None, None), rows[5]]
    return rows


def test_repeats_are_those_of_brute_force(spark, tmp_path):
    rows = feedback_rows(random.Random(3))
    schema = "id string, batch_no int, status string, other string, question struct<type: string, instructions: string, options: array<string>, levels: array<string>>, state string, state_sha256 string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "if(status is null, null, named_struct('status', status)) as review")
    got = {tuple(r) for r in history.repeats(df).collect()}
    want = repeats_by_hand(rows)
    assert got == want and len(want) > 30
    # batch by batch, against what was kept of the earlier ones: what is known when the batch arrives
    path = str(tmp_path)
    for b in range(1, 7):
        batch = df.where(f"batch_no = {b}")
        if b > 1:
            arrived = [r for r in rows if r[1] is not None and r[1] <= b]
            number = {r[0]: r[1] for r in arrived}
            assert {tuple(r) for r in history.against(path, batch).collect()} == {p for p in repeats_by_hand(arrived) if number[p[1]] == b}
        history.append(path, batch)


def repeats_by_hand(rows):
    key = lambda q: history.question_key(dict(zip(("type", "instructions", "options", "levels"), q)) if q else None)
    known = {}
    for r in sorted(rows, key=lambda r: str(r)):
        if r[6] and not history.is_redacted(r[5]) and parts(r[5]):
            known.setdefault(history.hash_key(r[6]), parts(r[5]))
    want = set()
    for a in rows:
        if a[2] != "confirmed" or a[1] is None:
            continue
        for b in rows:
            if b[1] is None or a[1] >= b[1] or key(a[4]) != key(b[4]):
                continue
            ha, hb = history.hash_key(a[6]), history.hash_key(b[6])
            sa = known.get(ha) if history.is_redacted(a[5]) else parts(a[5])
            sb = known.get(hb) if history.is_redacted(b[5]) else parts(b[5])
            if ha is not None and ha == hb or sa and sb and (wording.near_same(sa, sb) or sorted(map(bytes, sa)) == sorted(map(bytes, sb))):
                want.add((a[0], b[0]))
    return want


def test_repeats_of_nothing(spark):
    schema = "id string, batch_no int, review struct<status: string>, question struct<type: string, instructions: string, options: array<string>, levels: array<string>>, state string, state_sha256 string"
    assert history.repeats(spark.createDataFrame([], schema)).count() == 0


def test_leaks_are_those_of_brute_force(spark):
    rng = random.Random(5)
    v = voc(rng, 1500)
    sentence = lambda: " ".join(rng.choices(v, k=rng.randint(8, 14))).capitalize() + "."
    stock = " ".join(rng.choices(v, k=20)).capitalize() + "."
    han = "的一是了我不人在他有这个上们来到时大地为子中你说生国年着就那和要她出也得里后自以会家可下而过天去能对小多然于心学么之都好看起发当没成只如事把还用第样道想作种开美总从无情己面最女但现前些所同日手又行意动"
    items = []
    for i in range(30):
        zh = i % 6 == 0
        text = "".join(rng.choices(han, k=120)) if zh else (stock + " " if i % 2 else "") + " ".join(sentence() for _ in range(5))
        items.append((f"i-{i}", json.dumps({"text": text}, ensure_ascii=False) if i % 3 == 0 else text))
    items += [("i-null", None), ("i-empty", ""), ("i-short", "too short")]
    rows = []
    for i in range(300):
        text = " ".join(sentence() for _ in range(6))
        kind = i % 5
        src = rng.choice(items[:30])[1]
        body = json.loads(src)["text"] if src[0] == "{" else src
        if kind == 0 and body[0] < "⺀":
            w = body.split()
            at = rng.randint(0, max(0, len(w) - 30))
            text = text + " " + " ".join(w[at : at + rng.choice([9, 14, 17, 25])])
        elif kind == 0:
            text = text + body[10 : 10 + rng.choice([12, 33, 50])]
        elif kind == 1:
            text = dressed(rng, " ".join(edited(rng, body.split(), 0.08))) if body[0] < "⺀" else body[:60] + "山" + body[61:]
        elif kind == 2:
            text = stock + " " + text
        rows.append((f"r-{i}", text))
    rows += [("r-null", None), ("r-empty", ""), rows[0]]
    its = spark.createDataFrame(items, "item_id string, state_str string")
    held = leaks.read_items(its)
    want = set()
    for r, t in rows:
        for n in leaks.carried(t, list(held), held) if t else []:
            want.add((n, r))
    got = {tuple(x) for x in leaks.leaked(its, spark.createDataFrame(rows, "row_id string, text string")).collect()}
    assert got == want and len(want) > 60
    assert leaks.leaked(its.where("false"), spark.createDataFrame(rows, "row_id string, text string")).count() == 0
    assert leaks.leaked(its, spark.createDataFrame([], "row_id string, text string")).count() == 0


def test_stock_sentences_do_not_count(spark):
    stock = "These are the general words that stand on the back of each and every one of our papers here."
    items = [(f"i-{i}", f"{stock} Then follows number {i} with words of its own {'abcdefghijklmnopqrst'[i]}x.") for i in range(12)]
    its = spark.createDataFrame(items, "item_id string, state_str string")
    rows = spark.createDataFrame([("r", stock + " And nothing else of it is met in here.")], "row_id string, text string")
    assert leaks.leaked(its, rows).count() == 0
    assert leaks.leaked(its.where("item_id < 'i-2'"), rows).count() > 0


def across(spark, ev, tr):
    rows = [(f"e-{i}", True, t) for i, t in enumerate(ev)] + [(f"t-{i}", False, t) for i, t in enumerate(tr)]
    return {tuple(r) for r in overlap.near_same_across(spark.createDataFrame(rows, "id string, ev boolean, text string")).collect()}


def every_pair(ev, tr):
    e, t = [parts(x) for x in ev], [parts(x) for x in tr]
    return {(f"e-{i}", f"t-{j}") for i, a in enumerate(e) for j, b in enumerate(t) if wording.near_same(a, b)}


def even_edits(words, edits, mark, shift=8):
    """The words with so many of them replaced, evenly spread from a place on."""
    out = list(words)
    for k in range(edits):
        out[k * (len(out) // edits) + shift % (len(out) // edits)] = f"zq{mark}x{k}"
    return " ".join(out)


def test_large_groups_of_near_copies_are_whole(spark):
    """Copies of one wording, each with evenly spread edits of its own: every group of starts is over GROUP."""
    rng = random.Random(21)
    base = rng.choices(voc(rng), k=64)
    ev, tr = ([even_edits(base, 4, f"{x}{i}", i) for i in range(40)] for x in "et")
    want = every_pair(ev, tr)
    assert len(want) == 1600 and across(spark, ev, tr) == want


def test_copies_of_one_text_are_one_class_and_keep_their_near_copies(spark, monkeypatch):
    """A text held by many rows is no hot start, and a near copy whose own 16-word starts differ meets it."""
    rng = random.Random(22)
    v = voc(rng)
    base = rng.choices(v, k=64)
    ev = [even_edits(base, 4, "v")] + [" ".join(rng.choices(v, k=40)) for _ in range(10)]
    tr = [" ".join(base)] * 60 + [" ".join(rng.choices(v, k=40)) for _ in range(20)]
    monkeypatch.setattr(overlap, "HOT_LEAST", 50)
    hot = []
    real = overlap._hot_starts
    monkeypatch.setattr(overlap, "_hot_starts", lambda *a: hot.append(real(*a)) or hot[-1])
    want = every_pair(ev, tr)
    assert len(want) == 60 and across(spark, ev, tr) == want and len(hot[0]) == 0


@pytest.mark.parametrize("size, words, edits", [(20, 64, 8), (75, 64, 4), (75, 160, 10), (75, 160, 4), (12, 33, 4), (12, 100, 12)])
def test_clusters_of_near_copies_are_whole(spark, size, words, edits):
    """Near copies of one text with edits at random places, in clusters small and large."""
    rng = random.Random(words + edits)
    base = rng.choices(voc(rng), k=words)

    def copy(mark):
        out = list(base)
        for k in rng.sample(range(words), edits if edits * 16 > words else edits // 2 + 1):
            out[k] = f"zq{mark}x{k}"
        return " ".join(out)

    ev, tr = [copy(f"e{i}") for i in range(size)], [copy(f"t{i}") for i in range(size)]
    if edits * 8 >= words - 7:  # of these only the pairs with the text itself are near-same
        ev[0] = " ".join(base)
    want = every_pair(ev, tr)
    assert len(want) >= size and across(spark, ev, tr) == want


def test_values_short_and_long_and_in_any_order_are_whole(spark):
    """JSON records of two to twelve values, some of them of one word, under other field names."""
    rng = random.Random(24)
    v = voc(rng)
    ev, tr = [], []
    for i in range(120):
        values = [rng.choices(v, k=rng.choice([1, 2, 3, 5, 12, 30])) for _ in range(rng.randint(2, 12))]
        n = sum(map(len, values))
        other = [list(x) for x in values]
        moved = rng.random() < 0.5 and len(other) > 1
        if moved:  # a border that lies elsewhere, and no edits
            at = rng.randrange(len(other) - 1)
            both = other[at] + other[at + 1]
            cut = rng.randint(1, len(both) - 1) if len(both) > 1 else 1
            other[at : at + 2] = [both[:cut], both[cut:]] if both[cut:] else [both]
        for at in [] if moved else rng.sample(range(n), n // 8):
            for x in other:
                if at < len(x):
                    x[at] = f"zq{i}x{at}"
                    break
                at -= len(x)
        ev.append(json.dumps({f"k{j:02d}": " ".join(x) for j, x in enumerate(values)}))
        tr.append(json.dumps({f"f{j:02d}": " ".join(x) for j, x in enumerate(other)}))
    want = every_pair(ev, tr)
    assert len(want) == 120 and across(spark, ev, tr) == want


def test_records_of_one_template_are_whole(spark, monkeypatch):
    """Records that differ only in the last word, their starts routed as hot: longer prefixes are over every bound or unique."""
    rng = random.Random(23)
    base = " ".join(rng.choices(voc(rng), k=47))
    ev, tr = [f"{base} qe{i}" for i in range(50)], [f"{base} qt{i}" for i in range(50)]
    monkeypatch.setattr(overlap, "HOT_LEAST", 50)
    want = every_pair(ev, tr)
    assert len(want) == 2500 and across(spark, ev, tr) == want


FEEDBACK = "id string, batch_no int, review struct<status: string>, question struct<type: string, instructions: string, options: array<string>, levels: array<string>>, state string, state_sha256 string"


def in_two_batches(old, new):
    """Accepted states of batch 1 and states of batch 2, of one question."""
    q = ("noul", "Is it so?", None, None)
    return [(f"a-{i}", 1, ("confirmed",), q, t, None) for i, t in enumerate(old)] + [(f"b-{i}", 2, None, q, t, None) for i, t in enumerate(new)]


def repeated(old, new):
    return {(f"a-{i}", f"b-{j}") for i, a in enumerate(map(parts, old)) for j, b in enumerate(map(parts, new)) if wording.near_same(a, b)}


def test_repeats_with_much_history_are_whole(spark):
    """Sixty states of one wording with evenly spread edits: all of their common chunks are common."""
    rng = random.Random(31)
    base = rng.choices(voc(rng), k=64)
    old, new = ([even_edits(base, 4, f"{x}{i}", i) for i in range(60)] for x in "ab")
    got = {tuple(r) for r in history.repeats(spark.createDataFrame(in_two_batches(old, new), FEEDBACK)).collect()}
    assert got == repeated(old, new) and len(got) == 3600


def test_repeats_of_short_and_repetitive_states_are_whole(spark, tmp_path):
    """23 against 24 words, and lines that stand many times with one word changed; also against kept history."""
    rng = random.Random(32)
    v = voc(rng)
    texts = [rng.choices(v, k=24) for _ in range(60)]
    lines = [rng.choices(v, k=3) * 20 for _ in range(10)]
    old = [" ".join(t) for t in texts + lines]
    new = [" ".join(t[:-1]) for t in texts] + [" ".join([*t[:30], "qq", *t[31:]]) for t in lines]
    df = spark.createDataFrame(in_two_batches(old, new), FEEDBACK)
    want = repeated(old, new)
    assert len(want) == 70
    history.append(str(tmp_path), df.where("batch_no = 1"))
    assert {tuple(r) for r in history.against(str(tmp_path), df.where("batch_no = 2")).collect()} == want
    assert {tuple(r) for r in history.repeats(df).collect()} == want


@pytest.mark.parametrize("size, words, edits", [(20, 64, 8), (75, 64, 4), (75, 160, 10), (75, 160, 4), (40, 9, 1), (40, 26, 3)])
def test_repeats_of_clusters_are_whole(spark, monkeypatch, size, words, edits):
    """Near copies of one state with edits at random places; the table's frequent chunks are salted."""
    monkeypatch.setattr(history, "SALTED", 50)
    rng = random.Random(words * 7 + edits)
    base = rng.choices(voc(rng), k=words)

    def copy(mark):
        out = list(base)
        for k in rng.sample(range(words), edits):
            out[k] = f"zq{mark}x{k}"
        return " ".join(out)

    old, new = [copy(f"e{i}") for i in range(size)], [copy(f"t{i}") for i in range(size)]
    old[0] = " ".join(base)
    got = {tuple(r) for r in history.repeats(spark.createDataFrame(in_two_batches(old, new), FEEDBACK)).collect()}
    assert got == repeated(old, new) and len(got) >= size


def test_chunks_survive_edits():
    """Of the chunks of a state at most two for each changed, dropped or added word are not in the other one."""
    rng = random.Random(33)
    v = voc(rng, 300)
    for _ in range(300):
        words = rng.choices(v, k=rng.randint(1, 80))
        edits = rng.randint(0, len(words) // 8)
        other = list(words)
        for _ in range(edits):
            at = rng.randrange(len(other)) if other else 0
            other[at : at + rng.choice([0, 1])] = rng.choice([[], [rng.choice(v)]])
        sides = []
        for w in (words, other):
            toks = (wording.hashes(w) >> 31).astype(np.int32)
            _, key, _, single = history.chunks_of(np.zeros(1, np.int64), [np.array([len(w)], np.int32).tobytes()], [toks.tobytes()], [bytes(map(len, w))])
            sides.append(set(key[~single].tolist()))
        assert len(sides[0] - sides[1]) <= 2 * edits and len(sides[1] - sides[0]) <= 2 * edits


def test_short_items_and_items_mostly_of_stock_are_found(spark):
    """Items with fewer terms than a whole wording usually needs, carried word by word or with what may be changed."""
    stock = "These are the general words that stand on the back of each and every one of our papers here."
    items = [
        (f"s-{i}", f"{stock} {w}") for i,
        w in enumerate(
            " ".join(x) for x in zip("amber bold crisp dense eager frail grand harsh ivory jolly keen lofty".split(), ["otter"] * 12, "runs swims digs hides eats hunts naps sings dives barks plays waits".split())
        )
    ]
    items += [
        ("f-4", "green tractors hum softly"), ("f-6", "the quiet engine turns over twice"), ("f-1", "xylograph"),
        ("f-v", '{"a": "yes", "b": "zymurgist", "c": "quoin"}')
    ]
    its = spark.createDataFrame(items, "item_id string, state_str string")
    rows = [(f"r-{n}", f"before it stands much else and then {t if t[0] != '{' else 'yes zymurgist quoin'} and so on it goes") for n, t in items]
    rows += [("r-none", "nothing of the kind is in this text about a tractor"), ("r-edit", f"well {stock.replace('general', 'usual')} amber otter runs away")]
    got = {tuple(x) for x in leaks.leaked(its, spark.createDataFrame(rows, "row_id string, text string")).collect()}
    # each row carries its own item; with two of 22 words changed it also carries those of the others that differ in two words only
    held = leaks.read_items(its)
    want = {(n, r) for r, t in rows for n in leaks.carried(t, list(held), held)}
    assert got == want and {(n, f"r-{n}") for n, _ in items} <= got and ("s-0", "r-edit") in got and not any(r == "r-none" for _, r in got)


def test_characters_within_words_are_found(spark):
    """Thirty characters of an item within a text of many Latin words, against a plain search for substrings."""
    rng = random.Random(12)
    han = [chr(0x4E00 + i) for i in range(600)]
    body = "".join(rng.choices(han, k=90))
    latin = " ".join(rng.choices(voc(rng), k=70))
    rows = [(f"r-{k}", f"{latin} {body[7 : 7 + k]} {latin}") for k in (12, 29, 30, 31, 60)]
    its = spark.createDataFrame([("i", body)], "item_id string, state_str string")
    want = {("i", r) for r, t in rows if any(body[k : k + 30] in t for k in range(61))}
    got = {tuple(x) for x in leaks.leaked(its, spark.createDataFrame(rows, "row_id string, text string")).collect()}
    assert got == want and len(want) == 3


def test_index_serves_other_items(spark):
    """The stored index is built once; a second set of items only looks into it."""
    rng = random.Random(13)
    v = voc(rng)
    rows = [(f"r-{i}", " ".join(rng.choices(v, k=60))) for i in range(40)]
    source = spark.createDataFrame(rows, "row_id string, text string").selectExpr("row_id", "xxhash64(text) as th", "text")
    index = leaks.build_index(source)
    for first in (3, 20):
        its = spark.createDataFrame([(f"i-{i}", rows[i][1]) for i in range(first, first + 5)], "item_id string, state_str string")
        got = {tuple(x) for x in leaks.leaked_by(index, source, leaks.read_items(its)).collect()}
        assert got == {(f"i-{i}", f"r-{i}") for i in range(first, first + 5)}


def test_repeats_with_values_in_other_places_are_whole(spark):
    """States of several values whose borders lie elsewhere or whose fields have other names, and so another order."""
    rng = random.Random(35)
    v = voc(rng)
    old, new = [], []
    for i in range(80):
        values = [rng.choices(v, k=rng.choice([3, 9, 25])) for _ in range(rng.randint(2, 4))]
        other = [list(x) for x in values]
        if i % 2:
            both = other[0] + other[1]
            cut = rng.randint(1, len(both) - 1)
            other[:2] = [both[:cut], both[cut:]]
        else:
            at = rng.randrange(len(other[0]))
            other[0][at] = f"zq{i}"
        names = [f"k{j}" for j in range(len(values))]
        old.append(json.dumps({k: " ".join(x) for k, x in zip(names, values)}))
        new.append(json.dumps({k: " ".join(x) for k, x in zip(names if i % 2 else reversed(names), other)}))
    want = repeated(old, new)
    got = {tuple(r) for r in history.repeats(spark.createDataFrame(in_two_batches(old, new), FEEDBACK)).collect()}
    assert got == want and len(want) > 70


def test_looked_up_chunks_stand_apart():
    """An edit destroys one of the chunks that are looked up at most, another order of values none, so some 2 more than edits are enough."""
    rng = random.Random(36)
    v, sure = voc(rng, 300), 0
    for k in range(300):
        values = [rng.choices(v, k=rng.randint(20, 60)) for _ in range(rng.randint(1, 4))]
        n = sum(map(len, values))
        edits = rng.randint(0, n // 8)
        other = [list(x) for x in values]
        for _ in range(edits):
            x = rng.choice([x for x in other if len(x) > 1])
            at = rng.randrange(len(x))
            x[at : at + rng.choice([0, 1])] = rng.choice([[], [rng.choice(v)]])
        if k % 2:
            rng.shuffle(other)
        batches = []
        for x in (values, other):
            lens, toks = np.array(list(map(len, x)), np.int32).tobytes(), (wording.hashes(sum(x, [])) >> 31).astype(np.int32).tobytes()
            columns = [pa.array([y]) for y in (sum(map(len, x)), 0, 0, lens, toks, bytes(len(w) for p in x for w in p))]
            batches.append(pa.RecordBatch.from_arrays(columns, ["n", "qkey", "skey", "lens", "toks", "sizes"]))
        ones = np.ones(history.bags.BUCKETS, np.int64)
        found = pa.Table.from_batches(history._lookups(ones, ones)(iter(batches[:1])))
        there = set(pa.Table.from_batches(history._table_rows(iter(batches[1:])))["chunk"].to_pylist())
        got = found["chunk"].to_pylist()
        if found["lost"][0].as_py() < 0:  # else it has too few that stand apart
            sure += 1
            assert n // 7 < len(got) <= n // 7 + history.BEYOND and sum(x not in there for x in got) <= edits
    assert sure > 250


def test_repeated_feedback_has_each_pair_once_without_what_was_shuffled(spark, tmp_path):
    """Whole rows repeated and an id in two batches; the chunks of an own history are gone once the pairs of states are known."""
    text = " ".join(random.Random(37).choices(voc(random.Random(38)), k=40))
    q = ("noul", "Is it so?", None, None)
    rows = [("a", 1, ("confirmed",), q, text, None)] * 2 + [("b", 2, ("confirmed",), q, text + " x", None), ("b", 3, None, q, text, None), ("a", 4, None, q, text, None)]
    df = spark.createDataFrame(rows, FEEDBACK)
    before = set(store._tables)
    assert [tuple(r) for r in history.repeated_feedback(df).collect()] == [("a", "b")]
    own = {p.rpartition("/")[2].rpartition("-")[0]: p.removeprefix("file://") for p in set(store._tables) - before}
    assert "p2-rows" not in own and os.listdir(own["p2-history"]) == ["records"]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_rows_of_the_index_are_short(spark, monkeypatch):
    """However many postings a task has, no row of the index and no batch of rows is large, and a term that lies on both sides of a cut is found whole."""
    rng = random.Random(39)
    v = voc(rng, 50)
    rows = [(f"r-{i}", " ".join(rng.choices(v, k=300))) for i in range(200)]
    source = spark.createDataFrame(rows, "row_id string, text string").selectExpr("row_id", "xxhash64(text) as th", "text").coalesce(1).cache()
    index = leaks.build_index(source)
    runs = [(len(r.terms), len(r.texts), len(r.places)) for r in index.collect()]
    assert sum(a for a, _, _ in runs) == 8 * 200 * 299 and all(a == b == 2 * c <= 8 * leaks.PIECE for a, b, c in runs)
    held = leaks.read_items(spark.createDataFrame([(f"i-{i}", rows[i][1]) for i in range(5)], "item_id string, state_str string"))
    assert {tuple(x) for x in leaks.leaked_by(index, source, held).collect()} == {(f"i-{i}", f"r-{i}") for i in range(5)}
    counts = lambda x: {tuple(r) for r in x.mapInArrow(leaks._found(leaks.all_terms(held), True), "term long, n long").groupBy("term").sum("n").collect()}
    monkeypatch.setattr(leaks, "PIECE", 1 << 40)
    assert counts(index) == counts(leaks.build_index(source))
    with store.setting(spark, spark_sql_execution_arrow_maxBytesPerBatch=str(leaks.AT_ONCE)):
        sizes = index.union(index).union(index).coalesce(1).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in bs), "n long")
        assert max(r.n for r in sizes.collect()) < leaks.AT_ONCE + 20 * 8192 * 2
