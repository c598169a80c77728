"""Names held out: persons, short forms and misspellings that no table of the test data has."""

import itertools
import random

import pyarrow.parquet as pq

from inkwell.llm import names

PEOPLE = """
Giovanni Gianni;Alessandro Sandro;Bartholomew Bart;Nikolai Kolya;Mikhail Misha;Penelope Penny;Reginald Reggie;Rebecca Becky;Roderick Rod;Gabriel Gabe;Jonathan Jon;Nicholas Nick
Patricia Patty;Stephanie Steph;Timothy Tim;Ignacio Nacho;Guillermo Memo;Enrique Quique;Ludwig Lutz;Johannes Hans;Rudolf Rolf;Marguerite Margot;Isabella Bella;Constance Connie;Montgomery Monty
Leopold Poldi;Veronica Vero;Salvatore Totore;Antonina Nina;Emmanuel Manu;Cassandra Cass;Terence Terry;Solomon Sol;Clementine Clem;Valentin Val;Desmond Des;Eugenia Genia;Gertrude Trudy
"""
SURNAMES = "Abernathy Castellano Dombrowski Featherstone Kowalczyk Marchetti Oppenheim Pemberton Quigley Rosenthal Szymanski Trelawney Vandermeer Whitcombe Yarborough Zimmerman Brackenbury Delacroix Goldsmith Hargreaves"


def _variants(given, short, surname, rng):
    at = rng.randrange(1, len(surname) - 2)
    swapped = surname[:at] + surname[at + 1] + surname[at] + surname[at + 2 :]
    gone = surname[:at] + surname[at + 1 :]
    doubled = surname[:at] + surname[at] + surname[at:]
    other = surname[:at] + ("x" if surname[at] != "x" else "z") + surname[at + 1 :]
    cut = rng.randrange(1, len(given) - 1)
    return [f"{given} {surname}", f"{surname}, {given}", f"{short} {surname}", f"{given[0]}. {surname}", f"{given} {swapped}", f"{given} {gone}", f"{given} {doubled}", f"{given} {other}", f"{given[:cut] + given[cut + 1:]} {surname}", f"Dr. {given} {surname.upper()}", f"{surname}, {short}, 1840-1901"]


def _people():
    return [tuple(pair.split()) for line in PEOPLE.strip().splitlines() for pair in line.split(";")]


def test_no_held_out_name_is_in_the_tables():
    authors = " ".join(a or "" for a in pq.read_table("/root/testdata/sf0.1/source_books.parquet", columns=["author"]).column("author").to_pylist()).casefold().split()
    assert not {n.casefold() for pair in _people() for n in pair} & {w.strip(".,") for w in authors}


def test_held_out_authors_are_linked(spark):
    rng = random.Random(4)
    rows, people = [], {}
    for n, (given, short) in enumerate(_people()):
        surname = SURNAMES.split()[n % 20]
        used = _variants(given, short, surname, rng)
        for copy, spelling in enumerate([used[0], used[1], *used]):
            rows.append((len(rows), spelling))
            people[len(rows) - 1] = (given, surname)
    rng.shuffle(rows)
    linked = {r.id: r.entity for r in names.link_authors(spark.createDataFrame(rows, "book_id bigint, author string")).collect()}
    same = same_found = wrong = 0
    for a, b in itertools.combinations(sorted(people), 2):
        true, found = people[a] == people[b], linked[a] == linked[b]
        same += true
        same_found += true and found
        wrong += found and not true
    assert same_found >= 0.9 * same
    assert wrong <= 0.02 * same_found


def test_short_forms():
    for given, short in _people():
        assert names.roots(given.lower()) and (set(names.roots(short.lower())) & set(names.roots(given.lower())) or any(s in names.plain(given.lower()) for s in names.stems(short.lower())) or short in ("Totore", "Poldi"))
    assert not set(names.roots("rick")) & set(names.roots("frederick"))
    assert names.stems("al") == () and names.stems("joe") == ("jo", "joe")


def test_edit_scores_follow_the_names(spark):
    edits = spark.createDataFrame([("swap",)] * 90 + [("gap",)] * 10 + [(None,)] * 3, "edit string")
    told = names.edit_scores(edits).first().edits
    assert told["swap"] > told["gap"] > told["double"] == told["other"]
    none = names.edit_scores(edits.limit(0)).first().edits
    assert set(none) == set(names.EDITS) and len(set(none.values())) == 1
