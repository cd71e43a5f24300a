from __future__ import annotations

import random

import pytest

from loomdex.llm.names import entities, parse, variant_pairs


@pytest.mark.parametrize(
    ("author", "kind", "first", "last"),
    [
        ("Zack Lindimsen <zack@x.example>", "person", "zack", "lindimsen"), ('"Voskavdale, Wilhelmina" <w@x>', "person", "wilhelmina", "voskavdale"), ("Dr. Ann B. Müller (Org)", "person", "ann", "muller"), ("W.C. Voskavdale", "short", "w", "voskavdale"),
        ("Kestettpont B.", "short", "b", "kestettpont"), ("zack_lindimsen", "person", "zack", "lindimsen"), ("The Foo Labs, Inc.", "org", "labs", "foo"), ("Labs of Foo", "org", "labs", "foo"), ("foo-labs", "org", "labs", "foo"), ("Foo Research Group", "org", "research", "foo"),
        ("Ann Bee via some-list", "person", "ann", "bee"), ("abee", "login", None, None), ("ghost", "none", None, None), ("", "none", None, None), (None, "none", None, None), ("x-merge-bot", "none", None, None), ("!!!", "none", None, None), ("a" * 100000, "login", None, None),
    ],
)
def test_parse(author, kind, first, last):
    got = parse(author)
    assert got[0] == kind and (first is None or got[1] == first) and (last is None or got[3] == last)


GROUPS = [
    ["Alexander Tarnosk", "Tarnosk, Alexander", "A. Tarnosk", "Sasha Tarnosk", "atarnosk", "ALEXANDER TARNOSK", "Alexnader Tarnosk", "alexander-tarnosk", "Alexander Tarnosk <a@x.example>", "Alexander Tarnsk"],
    ["Benjamin Tarnosk", "Ben Tarnosk", "tarnoskb"],
    ["Foo Works", "The Foo Works, Inc.", "Works of Foo", "fooworks", "FOO WORKS", "Foo Wroks"],
    ["Daniel Holm", "Dan Holm"], ["Daniela Holm", "Dani Holm"],
]


def test_links(spark):
    rows = [(a, 1) for g in GROUPS for a in g for _ in range(3 if a in ("Alexander Tarnosk", "Foo Works", "Daniel Holm", "Daniela Holm") else 1)]
    rows += [("D. Holm", 1), ("ghost", 1), (None, 1), ("", 1), ("ci-bot", 1)]
    links = {r.author: r.entity for r in entities(spark.createDataFrame(rows, "author string, entity int")).collect()}
    assert not {"ghost", "", "ci-bot", None} & set(links)
    for g in GROUPS:
        assert len({links[a] for a in g if a != "Foo Wroks"}) == 1, [(a, links[a]) for a in g]
    assert len({links[g[0]] for g in GROUPS}) == len(GROUPS)
    assert links["D. Holm"] not in {links["Daniel Holm"], links["Daniela Holm"]}  # could be either
    pairs = [(r.author_a, r.author_b) for r in variant_pairs(entities(spark.createDataFrame(rows, "author string, n int"))).collect()]
    assert all(a.encode() < b.encode() for a, b in pairs) and len(pairs) == len(set(pairs))


def test_segments_find_every_single_edit(spark):
    """Brute force: each one-edit spelling of a well-known surname is linked to it."""
    name = "oxbelelmoor"
    edits = {name[:i] + name[i + 1 :] for i in range(len(name))} | {name[:i] + "q" + name[i:] for i in range(len(name) + 1)} | {name[:i] + "q" + name[i + 1 :] for i in range(len(name))} | {name[:i] + name[i + 1] + name[i] + name[i + 2 :] for i in range(len(name) - 1)}
    rows = [(f"Marta {name.title()}", 1)] * 9 + [(f"marta  {name} ", 1)] + [(f"Marta {e.title()}", 1) for e in edits]
    links = {r.author: r.entity for r in entities(spark.createDataFrame(rows, "author string, n int")).collect()}
    assert {links[f"Marta {e.title()}"] for e in edits} == {f"person:marta:{name}"}


UNSEEN = [
    ("Zhang Wei", "Wei Zhang"), ("Jean-Luc Moreau", "Jean Luc Moreau"), ("Mary Ann Smith", "Mary Smith"), ("Anna Wong", "Anna Wnog"), ("Sebastian Petrov", "Sebastain Petrof"), ("Mohamed Salehi", "Muhammad Salehi"),
    ("Northwind Consortium", "Northwnd Consortium"), ("Oluwaseun Adebayo", "Oluwasuen Adebayo"), ("Fitzgerald Marchetti", "Fitzgerald Marcheti"), ("Bergstrom, Ingrid", "Ingrid Bergstorm"), ("Katarzyna Wisniewska", "Katarzyna Wisnewskaa"), ("Rajesh Subramanian", "Rajehs Subramanian"),
]


@pytest.mark.parametrize("times", [1, 3])
def test_unseen_pairs(spark, times):
    """Spellings that each occur once, or one of them more often, are linked; no pair is linked to another."""
    rows = [(a,) for p in UNSEEN for a in (*p[:1] * times, p[1])]
    links = {r.author: r.entity for r in entities(spark.createDataFrame(rows, "author string")).collect()}
    assert [p for p in UNSEEN if links[p[0]] != links[p[1]]] == []
    assert len({links[p[0]] for p in UNSEEN}) == len(UNSEEN)


def heldout(seed: int, people: int = 150) -> tuple[list[str], dict[str, int]]:
    """Spellings of invented people by a seeded generator, none from a test table: the plain name, and two of: a typo in either part, a swap, the parts turned, an initial, no hyphen."""
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("bcdfghklmnprstvz") + rnd.choice("aeiou") for _ in range(n))

    def typo(w: str) -> str:
        i = rnd.randrange(1, len(w) - 1)
        return rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice("aeiourst") + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + rnd.choice("xyzq") + w[i + 1 :]])

    owner: dict[str, int] = {}
    for who in range(people):
        g, s = word(rnd.randint(2, 4)).title(), word(rnd.randint(3, 5)).title()
        made = [f"{g} {s}", *rnd.sample([f"{g} {typo(s.lower()).title()}", f"{typo(g.lower()).title()} {s}", f"{s}, {g}", f"{s} {g}", f"{g[0]}. {s}", f"{g}-{s}", f"{g.lower()}{s.lower()}", f"{g} M. {s}", f"{g} Maria {s}"], 2)]
        for a in made:
            owner.setdefault(a, who)
    return list(owner), owner


def test_heldout(spark):
    """Recall and precision of pairs on held-out invented people, every spelling once."""
    rows, owner = heldout(11)
    got = {(r.author_a, r.author_b) for r in variant_pairs(entities(spark.createDataFrame([(a,) for a in rows], "author string"))).collect()}
    true = {(a, b) for a in rows for b in rows if owner[a] == owner[b] and a.encode() < b.encode()}
    both = len(got & true)
    print("recall", both / len(true), "precision", both / len(got), sorted(true - got)[:20], sorted(got - true)[:20])
    assert both / len(true) >= 0.9 and both / len(got) >= 0.9


def test_hot_surname(spark):
    """A surname that a third of all spellings hold, and names with neighbours that are each written in several ways."""
    rows = [(f"{chr(97 + i % 26)}{chr(97 + i // 26)}kelomunda Smith",) for i in range(200)] + [(f"Person{i:03d} Other{i:03d}x",) for i in range(50)]
    assert entities(spark.createDataFrame(rows, "author string")).count() == len(set(rows))


def test_empty(spark):
    assert entities(spark.createDataFrame([], "author string")).count() == 0


def test_misspelt_in_several_forms(spark):
    """A misspelling is found by its relative support: written in two ways, backed by an initial, with a short surname or a short given name."""
    ways = lambda g, s: [f"{g} {s}", f"{s}, {g}", f"{g} {s} <{g[0]}{s}@x.example>".lower(), f"{g.lower()}  {s.lower()}", f"{g} {s}".upper(), f"{g} {s} (Org)"]
    right = [("Samantha", "Kestimimner"), ("Marta", "Oxbelelmoor"), ("Edward", "Lindegoz"), ("David", "Holm"), ("Ann", "Voskavdale")]
    wrong = [("Samntha", "Kestimimner"), ("Marta", "Oxbelelmor"), ("Edward", "Lindegzo"), ("David", "Hlom"), ("An", "Voskavdale")]
    rows = [(w, 1) for g, s in right for w in ways(g, s)] * 9 + [(w, 1) for g, s in wrong[:2] for w in ways(g, s)[:2]] + [(f"{g} {s}", 1) for g, s in wrong[2:]] + [("E. Lindegzo", 1)]
    rows += [(f"{g} Voskavdale", 1) for g in ("Edward",)] + [(f"Ann {s}", 1) for s in ("Moorner", "Kestodale", "Garrwick", "Dovarner", "Queluner", "Haskequist", "Tarnutani")]
    # Two people: both written in several ways.
    rows += [(w, 1) for s in ("Ullulen", "Ullusen") for w in ways("Thomas", s)[: 2 if s == "Ullulen" else 3]] + [(w, 1) for s in ("Lee", "Lie") for w in ways("Robert", s)[:2]]
    links = {r.author: r.entity for r in entities(spark.createDataFrame(rows, "author string, n int")).collect()}
    for (g, s), (g2, s2) in zip(right, wrong):
        assert links[f"{g2} {s2}"] == links[f"{g} {s}"], (g2, s2)
    assert links["Kestimimner, Samntha"] == links["Samantha Kestimimner"] and links["Oxbelelmor, Marta"] == links["Marta Oxbelelmoor"]
    assert links["Thomas Ullulen"] != links["Thomas Ullusen"] and links["Robert Lee"] != links["Robert Lie"]
