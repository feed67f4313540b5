"""The feed's JSON types and damaged requests, and deliveries of one code walked one by one."""

import json
import random

from tessellate.plans import feed

CATEGORIES, WORKS = ("A", "B", "C", "D"), ("x", "y")
GOOD = {"projectCode": "P", "client": "c", "projectName": "n", "contractPath": "/c"}


def errors(spark, *bodies):
    rows = feed.records(spark.createDataFrame(list(enumerate(bodies)), "id int, body string"))
    return [(r.id, r.place, r.projectCode, r.error) for r in feed.validated(rows, CATEGORIES, WORKS).orderBy("id", "place").collect()]


def test_values_of_a_wrong_type(spark):
    cases = [
        ({}, None), ({"budgetAmount": "12", "budgetSource": "contract"}, "budgetAmount: no number from 0"), ({"year": "2020"}, "year: out of range"), ({"client": 5}, "client: empty"),
        ({"tags": "A"}, "tags: unknown"), ({"tags": ["A", 5]}, "tags: unknown"), ({"tags": [None]}, "tags: unknown"), ({"tags": []}, None), ({"tags": ["A", "A"]}, "tags: repeated"),
        ({"year": 2020.5}, "year: out of range"), ({"year": 2020.0}, None), ({"year": True}, "year: out of range"), ({"descriptionTh": 7}, "descriptionTh: no text"), ({"budgetNote": ["x"]}, "budgetNote: no text"),
        ({"contractPath": 1}, "contractPath: empty"), ({"descriptionSource": 1}, "descriptionSource: unknown"), ({"category": ["A"]}, "category: unknown"), ({"certificateDate": 20240101, "certificatePath": "/w"}, "certificateDate: no day"),
        ({"projectCode": {"a": 1}}, "projectCode: empty"), ({"budgetAmount": None, "tags": None, "year": None}, None), ({"workTypes": {"x": 1}}, "workTypes: unknown"), ({"vatStatus": 0}, "vatStatus: unknown"),
    ]
    body = json.dumps({"projects": [GOOD | change for change, _ in cases] + [7, None, "P", ["P"]]})
    got = [e for _, _, _, e in errors(spark, body)]
    assert got == [e for _, e in cases] + ["record: no object"] * 4


def test_damaged_requests_are_reported(spark):
    good = json.dumps({"projects": [GOOD]})
    bodies = [None, "", "{", good[:-3], "[]", "7", '{"projects": {}}', '{"projects": []}', '{"projects": "none"}', '{"other": 1}', json.dumps({"projects": [GOOD] * 5001}), good]
    got = errors(spark, *bodies)
    want = ["request: no JSON"] * 4 + ["request: no projects"] * 6 + ["request: too many records"]
    assert got == [(i, None, None, e) for i, e in enumerate(want)] + [(11, 0, "P", None)]


def walk(card, deliveries):
    """One delivery after the other, as the receiving side takes them."""
    for d in deliveries:
        if card is None:
            card = dict(d)
            continue
        card["client"] = d["client"]
        if not card.get("classificationEdited"):
            card["category"] = d["category"] or card["category"]
            card["tags"] = [t for t in (d["tags"] or card["tags"]) if t != card["category"]]
    return card


def test_deliveries_in_order(spark):
    rng = random.Random(7)
    fields = ("client", "projectName", *feed.BLANKS, *feed.NULLS, *feed.LISTS)
    blank = {c: "" for c in feed.BLANKS} | dict.fromkeys(feed.NULLS) | {c: [] for c in feed.LISTS} | {"projectName": "n"}
    cards, sent = {}, {}
    for i in range(120):
        code = f"P{i}"
        if i % 3:
            cards[code] = blank | {"client": "old", "category": rng.choice([None, *CATEGORIES]), "tags": rng.sample(CATEGORIES, rng.randint(0, 3)), "classificationEdited": i % 10 == 1}
        sent[code] = []
        for k in range(rng.randint(0 if i % 3 else 1, 5)):
            category = rng.choice([None, None, *CATEGORIES])
            tags = [t for t in rng.sample(CATEGORIES, rng.choice([0, 0, 2, 3])) if t != category]
            sent[code].append(blank | {"client": f"c{k}", "category": category, "tags": tags})
    types = "projectCode string, " + ", ".join(f"{c} {'array<string>' if c in feed.LISTS else 'double' if c == 'budgetAmount' else 'int' if c == 'year' else 'date' if c == 'certificateDate' else 'string'}" for c in fields)
    stored = spark.createDataFrame([(code, *[c[f] for f in fields], False, c["classificationEdited"], False, False) for code, c in cards.items()], types + ", " + ", ".join(f"{lock} boolean" for lock in feed.LOCKS))
    deliveries = spark.createDataFrame([(code, *[d[f] for f in fields], k) for code, ds in sent.items() for k, d in enumerate(ds)], types + ", seq int")
    got = {r.projectCode: (r.client, r.category, r.tags) for r in feed.merge_cards(stored, deliveries).collect()}
    want = {code: walk(dict(cards[code]) if code in cards else None, sent[code]) for code in sent}
    assert got == {code: (c["client"], c["category"], c["tags"]) for code, c in want.items()}


def test_three_deliveries(spark):
    """Tags that met a category on the way don't come back when the category changes again."""
    fields = ("client", "projectName", *feed.BLANKS, *feed.NULLS, *feed.LISTS)
    types = "projectCode string, " + ", ".join(f"{c} {'array<string>' if c in feed.LISTS else 'double' if c == 'budgetAmount' else 'int' if c == 'year' else 'date' if c == 'certificateDate' else 'string'}" for c in fields)
    row = lambda category, tags: ("P", "c", "n", *[""] * 3, *[None] * 9, category, tags, [])
    stored = spark.createDataFrame([(*row("SMALL", ["LARGE", "PROMO"]), False, False, False, False)], types + ", " + ", ".join(f"{lock} boolean" for lock in feed.LOCKS))
    sent = spark.createDataFrame([(*row("LARGE", []), 1), (*row("PROMO", []), 2), (*row(None, []), 3)], types + ", seq int")
    assert [(r.category, r.tags, r.n_updates) for r in feed.merge_cards(stored, sent).collect()] == [("PROMO", [], 3)]
