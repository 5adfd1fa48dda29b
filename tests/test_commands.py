"""Change commands from text: all kinds, malformed ones, short forms against a schema."""

from __future__ import annotations

import pytest

from loomgraph.operators import commands

GOOD = {
    "create class 'Legal_Entity'": ("create class", {"target": "Legal_Entity"}),
    "obsolete class 'Old Type'": ("obsolete class", {"target": "Old Type"}),
    "change description of 'Person'": ("change description", {"target": "Person"}),
    "create relationship 'employs'": ("create relationship", {"target": "employs"}),
    "obsolete relationship 'owns'": ("obsolete relationship", {"target": "owns"}),
    "change relationship 'manages'": ("change relationship", {"target": "manages"}),
    "add property 'email' to class 'Person'": ("add property", {"property": "email", "target": "Person"}),
    "remove property 'fax' from class 'Company'": ("remove property", {"property": "fax", "target": "Company"}),
    "change property 'name' on class 'Person'": ("change property", {"property": "name", "target": "Person"}),
    "add synonym 'Corp' for class 'Company'": ("add synonym", {"new_name": "Corp", "target": "Company"}),
    "rename property 'a' to 'b' on class 'Person'": ("rename property", {"property": "a", "new_name": "b", "target": "Person"}),
    "split class 'Entity' into 'One' 'Two'  'Three'": ("split class", {"target": "Entity", "into": ["One", "Two", "Three"]}),
    "move class 'Sub' from 'Old' to 'New'": ("move class", {"target": "Sub", "old_name": "Old", "new_name": "New"}),
    "change domain of 'employs' to 'Org'": ("change domain or range", {"side": "domain", "target": "employs", "new_name": "Org"}),
    "  CHANGE  Range of 'employs' to 'Person' ": ("change domain or range", {"side": "range", "target": "employs", "new_name": "Person"}),
    "remove property 'fax'": ("remove property", {"property": "fax", "target": "Company"}),
    "rename property 'fax' to 'telefax'": ("rename property", {"property": "fax", "new_name": "telefax", "target": "Company"}),
}
BAD = {
    "create class": "malformed create class", "create class 'A' 'B'": "malformed create class", "change description 'Person'": "malformed change description",
    "add property 'email' class 'Person'": "malformed add property", "split class 'A' into 'B'": "malformed split class", "move class 'A' to 'B'": "malformed move class",
    "change domain 'x' to 'y'": "malformed change domain or range", "drop class 'A'": "unknown command", "": "empty command", "   ": "empty command", None: "empty command",
    "create class 'A": "open quote", "create class ''": "malformed create class", "remove property 'none'": "not found", "change property 'name'": "ambiguous", "obsolete 'A'": "unknown command",
}


@pytest.fixture(scope="module")
def found(spark):
    schema = spark.createDataFrame([("Company", "fax"), ("Company", "name"), ("Person", "name"), ("Bare", None)], "class string, property string")
    lines = spark.createDataFrame([(k, text) for k, text in enumerate([*GOOD, *BAD])], "n long, text string")
    return {r.text: r for r in commands.read_commands(lines, "text", schema).collect()}


def test_all_kinds_are_read(found):
    assert {kind for kind, _ in GOOD.values()} == set(commands.FORMS)
    for text, (kind, fields) in GOOD.items():
        row = found[text]
        assert (row.kind, row.error) == (kind, None)
        assert {f: row[f] for f in commands.FIELDS if row[f] is not None} == fields


def test_errors_are_named(found):
    assert {text: found[text].error for text in BAD} == BAD
