import re

from loam.llm import decontamination as dc

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"
ITEM = "Anna bought 12 kg of flour for the bakery in Paris and then sold 7 of the bags to Bob for cash yesterday"


def found(spark, docs, items, **how):
    return {(r["doc_id"], r["item_id"]): r for r in dc.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **how).collect()}


def test_copies_and_reparameterised_questions(spark):
    docs = [
        (1, f"Before. {ITEM}. After.", None),
        (2, "Note that Carl bought 55 lb of flour for the bakery in Rome and then sold 9 of the bags to Dan for cash yesterday.", None),
        (3, "Nothing of the kind is in this text at all, although it has a bakery in Paris and 12 kg of flour.", None),
    ]
    for bound in (500_000, 0):  # both ways of joining
        got = found(spark, docs, [(7, ITEM, "x")], broadcast_windows=bound)
        assert set(got) == {(1, 7), (2, 7)}
        assert got[(1, 7)]["same_slots"] and not got[(2, 7)]["same_slots"]


def test_slots_must_be_consistent(spark):
    item = "take 5 of the red balls and put 5 of the blue balls into the box with the other balls"
    ok = "take 8 of the red balls and put 8 of the blue balls into the box with the other balls"
    bad = "take 8 of the red balls and put 9 of the blue balls into the box with the other balls"
    assert set(found(spark, [(1, ok, None), (2, bad, None)], [(1, item, None)])) == {(1, 1)}


def test_odd_rows(spark):
    items = [(1, ITEM, None), (2, None, None), (3, "", None), (4, "only four words here", None), (5, "these are just six plain words", None), (1, ITEM, None)]
    docs = [(1, None, None), (2, "", None), (None, f"x. {ITEM}.", None), (4, ITEM, None), (4, ITEM, None), (5, "so these are just six plain words now", None), (6, "word " * 50_000 + ITEM, None), (7, "only four words here", None)]
    assert set(found(spark, docs, items)) == {(None, 1), (4, 1), (5, 5), (6, 1), (7, 4)}
    rows = dc.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert rows.count() == 6  # document 4 twice, item 1 once
    assert not found(spark, docs, []) and not found(spark, [], items)


def test_query_equals_brute_force(spark, sf_dir):
    word = re.compile(r"\w+")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    windows = {}
    for i, t in items.select("item_id", "text").collect():
        w = word.findall(t.lower())
        windows[i] = {tuple(w[k : k + 8]) for k in range(max(1, len(w) - 7))}
    want = set()
    for d, t in docs.select("doc_id", "text").collect():
        w = word.findall(t.lower())
        have = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        want |= {(d, i) for i, own in windows.items() if len(own & have) >= 0.5 * len(own)}
    assert {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, items).collect()} == want and want


def test_a_text_whose_length_changes_in_lower_case_leaves_others_alone(spark):
    other = ITEM.replace("Anna", "Carl").replace("Paris", "Rome").replace("12 kg", "3 lb")
    docs = [(1, "İİ " + "word " * 20, None), (2, f"See that {other}", None), (3, f"İ x. {ITEM.replace('in Paris', 'in paris').replace('to Bob', 'to bob')}", None)]
    got = found(spark, docs, [(1, ITEM, None)])
    assert (2, 1) in got and (1, 1) not in got


def test_verbatim_copies_in_another_case_or_beside_a_character_that_changes_length(spark):
    other = ITEM.replace("Anna", "Carl").replace("Paris", "Rome").replace("12 kg", "3 lb").replace("Bob", "Dan")
    docs = [(1, ITEM.upper(), None), (2, ITEM.lower(), None), (3, f"See 20 K, İ and ẞ. So {other}", None), (4, f"see that {ITEM.lower().replace('12', '31')}", None)]
    for bound in (500_000, 0):
        got = found(spark, docs, [(1, ITEM, None)], broadcast_windows=bound)
        assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1)}
        assert [got[(k, 1)]["same_slots"] for k in (1, 2, 3, 4)] == [True, True, False, False]
    digits = "7 8 9 10 11 and 12 13 14 15 16 17 18"
    assert set(found(spark, [(1, f"so {digits}", None)], [(1, digits, None)])) == {(1, 1)}


def test_names_that_open_sentences(spark):
    item = "Tom has 5 apples. Sara gives Tom 3 more. How many apples does Tom have now?"
    ask = lambda a, b, x, y: f"{a} has {x} apples. {b} gives {a} {y} more. How many apples does {a} have now?"
    docs = [(1, ask("Ben", "Lucy", 9, 4), None), (2, ask("Mary Ann", "Dr Lucy Hill", "1,200", "-4.5"), None), (3, "Note that " + ask("Émile", "Zoë", 9, 4), None), (4, ask("Ben", "Lucy", 9, 4).replace("does Ben", "does Lucy").replace("gives Ben", "gives Al"), None)]
    got = found(spark, docs, [(1, item, None)])
    assert set(got) == {(1, 1), (2, 1), (3, 1)} and not any(r["same_slots"] for r in got.values())


def test_numbers_and_names_of_other_lengths(spark):
    ask = lambda who, x, y, z: f"a train left from {who} at 60 and then went on for {x} miles until it came to {y} and there it stood for {z} hours in the rain".replace("60", str(x))
    docs = [(1, ask("Rome", "1,200", "New York City", "45.5"), None), (2, ask("Los Angeles", "7/8", "Bath", "3"), None)]
    got = found(spark, docs, [(1, ask("Paris", "60", "Lyon", "40"), None)])
    assert set(got) == {(1, 1), (2, 1)}


def test_neighbouring_diagonals_count_together(spark):
    longer = ITEM.replace("and then", "and quickly then")  # 5 windows before the word, 4 after, of 16
    other = longer.replace("Anna", "Carl").replace("12 kg", "3 lb").replace("7 of", "8 of").replace("Bob", "Dan")
    got = found(spark, [(1, longer, None), (2, other, None)], [(1, ITEM, None)])
    assert {k: r["n_windows"] for k, r in got.items()} == {(1, 1): 9, (2, 1): 9} and got[(1, 1)]["same_slots"] and not got[(2, 1)]["same_slots"]


def test_two_questions_asked_again_side_by_side(spark):
    ask = lambda x, y: f"take {x} of the red balls and put {x} of the blue balls into the {y} boxes"
    assert set(found(spark, [(1, f"{ask(8, 3)} {ask(9, 4)}", None)], [(1, ask(5, 2), None)])) == {(1, 1)}


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    """Coverage is not put together from several texts."""
    words = ITEM.split()
    parts = [" ".join(words[k : k + 10]) for k in range(0, len(words), 7)]
    for doc_id in (1, None):
        assert not found(spark, [(doc_id, p, None) for p in parts], [(1, ITEM, None)])
        assert len(found(spark, [(doc_id, p, None) for p in [*parts, ITEM]], [(1, ITEM, None)])) == 1


def test_a_window_of_all_items_pairs_no_document_with_all(spark):
    """Items share a long beginning: a document with it alone holds none of them, one with an item's own part holds that item."""
    start = "please answer the following question as well as you can and explain each step of it"
    items = [(i, f"{start} " + " ".join(f"q{i}w{k}" for k in range(24)), None) for i in range(60)]
    docs = [(i, f"so {start} now", None) for i in range(200)] + [(900, f"well {items[7][1]} indeed", None)]
    for bound in (500_000, 0):
        assert set(found(spark, docs, items, broadcast_windows=bound)) == {(900, 7)}


def plain_loop(doc, item, reach=8):
    """(share, windows) of an item in a document by comparing every window with every other, form by form and diagonal by diagonal."""

    def read(text, form):
        out = []
        for w in text.split():
            kind = "NUM" if w.isdigit() and form else "NAME" if w[0].isupper() and form == 2 else w.lower()
            out.append((kind, w.lower() if kind in ("NUM", "NAME") else None))
        return out

    best = (0.0, 0)
    for form in range(3):  # plain, numbers, numbers and names
        d, q = read(doc, form), read(item, form)
        literal = lambda x: sum(v is not None for _, v in x) <= 4
        asked = [k for k in range(len(q) - 7) if literal(q[k : k + 8])]
        runs = {}
        for k in asked:
            for p in range(len(d) - 7):
                if [x[0] for x in d[p : p + 8]] == [x[0] for x in q[k : k + 8]]:
                    ats, fills = runs.setdefault(p - k, (set(), set()))
                    ats.add(k)
                    fills |= {(a, b) for (_, a), (_, b) in zip(q[k : k + 8], d[p : p + 8], strict=True) if a is not None}
        steady = lambda f: len({a for a, _ in f}) == len(f)
        runs = {g: r for g, r in runs.items() if steady(r[1])}
        for g in runs:
            ats, fills = set(runs[g][0]), set(runs[g][1])
            for other in sorted((o for o in runs if abs(o - g) <= reach), key=lambda o: (abs(o - g), o)):
                if steady(fills | runs[other][1]):
                    ats |= runs[other][0]
                    fills |= runs[other][1]
            best = max(best, (len(ats) / len(asked), len(ats)))
    return best


def test_templates_and_slots_equal_a_plain_loop(spark):
    """Random texts of words, numbers and names, some asked again with other values, words put in or left out, or slots that disagree."""
    import numpy as np

    rng = np.random.RandomState(12)
    names, words = ["Anna", "Bob", "Carl", "Dora"], [f"w{chr(97 + k)}o" for k in range(6)]

    def sentence():
        out = ["so"]
        for _ in range(rng.randint(14, 26)):
            out.append(str(rng.randint(1, 5)) if rng.rand() < 0.15 else rng.choice(names) if rng.rand() < 0.15 and not out[-1][0].isupper() else rng.choice(words))
        return [*out, "end"]

    items, docs = {}, {}
    for i in range(25):
        items[i] = sentence()
    for j in range(150):
        own = list(items[rng.randint(len(items))])
        change = {n: rng.choice(names) for n in names} | {str(n): str(rng.randint(1, 9)) for n in range(1, 5)}
        own = [change.get(w, w) if rng.rand() < 0.95 else w for w in own]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(1, len(own) - 1)
            own = [*own[:at], *([rng.choice(words)] if rng.rand() < 0.5 else []), *own[at + (rng.rand() < 0.5) :]]
        own = [w for k, w in enumerate(own) if not (k and w[0].isupper() and own[k - 1][0].isupper())]
        docs[j] = ["before", *own, "after"] if rng.rand() < 0.7 else sentence()
    docs, items = {k: " ".join(v) for k, v in docs.items()}, {k: " ".join(v) for k, v in items.items()}
    want = {}
    for j, d in docs.items():
        for i, q in items.items():
            share, n = plain_loop(d, q)
            if share >= 0.5:
                want[(j, i)] = n
    got = found(spark, [(j, d, None) for j, d in docs.items()], [(i, q, None) for i, q in items.items()])
    assert {k: r["n_windows"] for k, r in got.items()} == want and len(want) > 20


def test_short_items_are_found_as_lines_and_sentences(spark):
    docs = [
        (1, "Who wrote Hamlet then"), (2, "We asked him. Who wrote Hamlet, then? Nobody knew."), (3, "first line\nwho WROTE hamlet then\nlast line"), (4, "He said who wrote Hamlet then and left."), (5, "Who wrote Hamlet then did"),
        (6, "Yes."), (7, "No. Yes! Maybe."), (8, "Yes it is."), (9, ""), (10, None), (11, "Say: one two"), (12, "a quite long text of many words, without any of those"),
    ]
    items = [("q", "Who wrote Hamlet then?"), ("y", "yes"), ("e", ""), ("n", None), ("t", "One two."), ("p", "Yes. Maybe")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(d, b).collect()}
    assert got == {(1, "q"), (2, "q"), (3, "q"), (6, "y"), (7, "y"), (7, "p"), (11, "t")}
    assert dc.contaminated(d, b.where("item_id in ('e', 'n')")).count() == 0


def test_numbers_in_other_writings_are_slots(spark):
    item = "A truck drives 60 miles in 2 hours along the coast road. How far does the truck drive in 5 hours at that speed?"
    docs = [
        (1, "A truck drives 75km in 3h along the coast road. How far does the truck drive in 4h at that speed?"),
        (2, "A truck drives seventy-five miles in three hours along the coast road. How far does the truck drive in twenty four hours at that speed?"),
        (3, "A truck drives past the house in two days. Along the river nobody asks how far that may be, at any speed you like to name."),
        (4, item.upper()),
    ]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r["doc_id"]: r["same_slots"] for r in dc.contaminated(d, b).collect()}
    assert set(got) == {1, 2, 4} and not got[1] and not got[2] and got[4]
