"""Lookups over small tables: nearest tokens, migrations, connections, catalogs and overlays in JSON, style objects."""

from __future__ import annotations

import json
import random

import pytest
from conftest import rows

from corbel.operators import lint, migration
from corbel.operators import tokens as ops
from corbel.sources import catalog_json, connect, markdown, markup
from corbel.sources.catalog import Workspace

TOKENS = "token_id long, system_id string, pos int, name string, css_var string, value string, values_by_theme array<struct<theme:string,value:string>>, category string, description string"


def token(i, value, category="color", themes=None, css=None, system="s"):
    return (i, system, i % 7, f"t-{i}", css, value, themes, category, None)


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_against_all_tokens(spark, seed):
    rng = random.Random(seed)
    shade = lambda: "#" + "".join(rng.choice("02468f") for _ in range(6))
    data = [token(i, shade()) for i in range(60)] + [token(i, f"{rng.choice([1, 2, 4, 8, 64, 500])}px", rng.choice(["space", "size"])) for i in range(60, 100)]
    data += [token(100, "var(--x)", themes=[("dark", "#000001"), (None, None)], css="--y"), token(101, "#123456", css="--x"), token(102, None), token(103, "#123456", system=None)]
    tokens = spark.createDataFrame(data, TOKENS)
    queries = [(i, "s", q) for i, q in enumerate(["#000000", "#ffffff", "rgb(1, 2, 3)", "#123456", "3px", "7", "-900px", "9999px", "none", None])] + [(20, None, "#123456"), (21, "other", "#123456")]
    asked = spark.createDataFrame(queries * 2, "query_id long, system_id string, query string").dropDuplicates()
    rgb = lambda v: tuple(int(v[k : k + 2], 16) for k in (1, 3, 5))
    ways = {t[0]: [rgb(t[5])] for t in data[:60]} | {100: [rgb("#123456"), (0, 0, 1)], 101: [rgb("#123456")]}
    got = {(q, r): (t, d) for q, r, t, d, _ in rows(ops.nearest_colors(tokens, asked))}
    for q, c in ((0, (0, 0, 0)), (1, (255, 255, 255)), (2, (1, 2, 3)), (3, rgb("#123456"))):
        far = {t: min(sum((a - b) ** 2 for a, b in zip(w, c)) ** 0.5 for w in ws) for t, ws in ways.items()}
        want = sorted(far, key=lambda t: (far[t], t % 7, t))[:6]
        assert [got[q, r][0] for r in range(1, 7)] == want and all(abs(got[q, r][1] - far[t]) < 1e-5 for r, t in enumerate(want, 1))
    assert not {q for q, _ in got} & {4, 5, 8, 9, 20, 21}
    px = {t[0]: float(t[5][:-2]) for t in data[60:100]}
    near = {(q, r): t for q, r, t, _ in rows(ops.nearest_lengths(tokens, asked))}
    for q, v in ((4, 3), (5, 7), (6, -900), (7, 9999)):
        assert [near[q, r] for r in range(1, 7)] == sorted(px, key=lambda t: (abs(px[t] - v), t % 7, t))[:6]
    assert rows(ops.nearest_colors(tokens.limit(0), asked)) == [] and rows(ops.nearest_lengths(tokens, asked.limit(0))) == []


def test_find_tokens_within_a_category(spark):
    tokens = spark.createDataFrame([token(1, "4px", "space"), token(2, "4px", "radius"), token(3, "#fff"), (4, "s", 0, "space-gap", None, None, None, "other", "A gap")], TOKENS)
    asked = [(1, "s", "4px", None), (2, "s", "4px", "radius"), (3, "s", "#fff", "space"), (4, "s", "gap", "other"), (5, "s", "gap", "color"), (6, "s", " ", None), (7, "s", "3px", "color")]
    got = sorted(rows(ops.find_tokens(tokens, spark.createDataFrame(asked, "query_id long, system_id string, query string, category string"))))
    assert got == [(1, 1, 1, "length", 0.0), (1, 2, 2, "length", 0.0), (2, 1, 2, "length", 0.0), (4, 1, 4, "words", 40.0)]


def workspace(spark):
    ws = Workspace(spark, "")
    prop = "name string, type string, required boolean, default_value string, description string, deprecated string"
    ws.exports = spark.createDataFrame(
        [(1, 0, "s", 0, "d", "Button", None, None, [("type", "string", None, None, None, "use kind"), None, ("Size", "string", None, None, None, None)], None, ("2.0", "NewButton", None)),
         (2, 0, "s", 1, "d", "Card", None, None, None, None, None), (3, 0, "t", 0, "d", "IconButton", None, None, [], None, None)],
        f"module_id long, epos int, system_id string, pos int, dir string, display_name string, tag_name string, description string, props array<struct<{', '.join(x.replace(' ', ':') for x in prop.split(', '))}>>, inherited_props array<string>, deprecated struct<since:string,replacement:string,note:string>",
    )
    ws.symbols = spark.createDataFrame([("s", "Button"), ("s", "Loose"), ("t", "IconButton"), (None, "Button"), ("s", None)], "system_id string, name string")
    return ws


def test_migrations(spark):
    ws = workspace(spark)
    logs = spark.createDataFrame([(1, "s", "# Log\n## 2.0\nButton goes.\nThe size of Card and Button\n### 2.1 #\nCard stays"), (2, "t", "Button"), (3, "s", None)], "doc_id long, system_id string, text string")
    names = ["Button", "button.TYPE", "Button.size", " Card ", "Ghost", "", None, "Button.none", ".x", "Card.nothing"]
    asked = spark.createDataFrame([(i, "s", n) for i, n in enumerate(names)] + [(20, None, "Button"), (21, "t", "IconButton")], "query_id long, system_id string, name string")
    got = {r[0]: r[1:] for r in rows(migration.migrations(ws, asked, logs))}
    lines = "2.0: Button goes. (3)\n2.0: The size of Card and Button (4)"
    assert got[0] == ("deprecated", "Button", None, "2.0", "NewButton", None, lines)
    assert got[1][:6] == ("deprecated", "Button", "TYPE", None, None, "use kind")
    assert got[2] == ("deprecated", "Button", "size", "2.0", "NewButton", None, lines)
    assert got[3] == ("mentioned", "Card", None, None, None, None, "2.0: The size of Card and Button (4)\n2.1: Card stays (6)")
    assert [got[i][0] for i in (4, 5, 6, 8, 20, 21)] == ["missing"] * 5 + ["none"] and got[9][0] == "mentioned" and len(got) == 12
    assert rows(migration.migrations(ws, asked.limit(0), logs)) == []
    files = spark.createDataFrame([("s", "codemods/rename-button.ts"), ("s", "codemods/card_Button.js"), ("t", "button.js"), ("s", None)], "system_id string, file string")
    parts = spark.createDataFrame([(1, "s", "Button"), (2, "s", "CardButton"), (3, "s", "utton"), (4, "s", None)], "query_id long, system_id string, component string")
    assert sorted(rows(migration.codemods(files, parts))) == [(1, "codemods/card_Button.js, codemods/rename-button.ts"), (2, "codemods/card_Button.js")]


CALLS = """figma.connect(Button, 'u?node-id=1-2', { props: { size: figma.enum("Size", { 'Big': "lg", md: 'md', 3: true }), tone: figma.enum('Tone') },
  example: ({ size }) => { return (<Button size={props.size}><b>{props.label}</b></Button>); } })
figma.connect(Ghost, 'v', { props: { a: figma.enum('A', { X: 'y' }) }, example: () => <Ghost /> })
figma.connect(Loose, 'w')"""


def test_connections_against_the_catalog(spark):
    ws = workspace(spark)
    files = spark.createDataFrame([("a", "s", CALLS), ("b", "s", None), ("c", "t", "no call")], "path string, system_id string, text string")
    exports = ws.exports.selectExpr("system_id", "display_name as name")
    got = sorted(rows(connect.matched(files, exports, ws.symbols)))
    assert [(r[3], r[4], r[5], r[6]) for r in got] == [
        ("Button", "mapped", "1:2", "<Button size={{size}}><b>{{label}}</b></Button>"), ("Ghost", "unmatched", "", "<Ghost />"), ("Loose", "created", "", None),
    ]
    assert sorted(rows(connect.connection_aliases(files, ws.symbols))) == [("s", "3", "true", "Button.size"), ("s", "Big", "lg", "Button.size")]
    assert rows(connect.matched(files.limit(0), exports, ws.symbols)) == []


def test_catalogs_in_json(spark):
    odd = {"components": [{"dir": 7, "exports": [{"props": [{"type": ["x"], "required": 1}, None, {"name": "b", "type": "T", "required": ""}]}, {"displayName": "A", "description": 3}]}, "no"]}
    df = spark.createDataFrame([(1, json.dumps(odd)), (2, '{"allExports": ["Z", "Y"], "components": []}'), (3, "{"), (4, None)], "record_id long, text string")
    tables = catalog_json.catalog_tables(df)
    assert sorted(r[2:] for r in rows(catalog_json.json_exports(tables).select("record_id", "key", "dir", "display_name", "tag_name", "description"))) == [("", "", None, ""), ("", "A", None, "")]
    assert sorted(rows(catalog_json.json_props(tables).select("pos", "name", "type", "required"))) == [(0, "", "unknown", True), (2, "b", "T", False)]
    assert sorted(rows(catalog_json.all_exports(df, tables))) == [(1, ""), (1, "A"), (2, "Y"), (2, "Z")]


def test_overlays(spark):
    texts = ['{"exports": [{"displayName": "A"}, {"displayName": 4}, null, 7]}', "[]", "{}", '{"exports": {}}', "nope", None, '{"exports": []}']
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    assert sorted(rows(catalog_json.overlay_problems(df))) == [("0", f"exports[{i}] has no displayName") for i in (1, 2, 3)] + [("1", "not an object"), ("2", "no exports array"), ("3", "no exports array"), ("4", "not valid JSON")]
    names = spark.createDataFrame([("s", "A"), ("s", "A"), ("s", "B"), ("t", "A"), ("s", None)], "system_id string, name string")
    assert sorted(r[:2] for r in rows(catalog_json.overlay_stubs(names, names.where("name = 'A' and system_id = 's'")))) == [("s", "B"), ("t", "A")]


def test_style_objects_and_pattern_components(spark):
    (_, _, attrs, *_), = markup.scan("<Box style={{ color: '#fff', \"marginTop\": 12, width: `3px`, x: y, n: -1.5 }} other={{ a: '1' }} />")
    assert attrs == [("style", "color: #fff; marginTop: 12px; width: 3px; n: -1.5px"), ("other", None)]
    docs = spark.createDataFrame([(1, "s", "<Card><x-tag a></x-tag></Card> <Cardx/>"), (2, "s", None), (3, None, "<Card />")], "doc_id long, system_id string, code string")
    names = spark.createDataFrame([("s", "Card"), ("s", "x-tag"), ("s", "Card"), ("s", None)], "system_id string, name string")
    assert rows(markdown.pattern_components(docs, names)) == [(1, "s", "Card x-tag")]


def test_findings_in_order(spark):
    ws = workspace(spark)
    ws.aliases = spark.createDataFrame([], "alias_id long, system_id string, kind string, pos int, alias string, target string, concept string, source string")
    ws.tokens = spark.createDataFrame([token(1, "#ffffff", css="--white", system="t")], TOKENS)
    code = "import { IconButton, Nope } from 't';\nimport x from 'y';\n<div><IconButton foo=\"1\" className=\"[3px]\" style={{ color: '#fff' }} /></div>"
    df = spark.createDataFrame([("1", "t", code), ("2", "t", None), ("3", None, "<a-b></a-b>"), ("4", "t", "<p>plain</p>")], "snippet_id string, system_id string, code string")
    got = [(r.rank, r.line, r.kind, r.subject, r.fix) for r in lint.usage_report(ws, df).where("snippet_id = '1'").orderBy("rank").collect()]
    assert got == [
        (1, 1, "unknown-component", "Nope", None), (2, 2, "disallowed-import", "y", None), (3, 3, "invented-prop", "IconButton.foo", None),
        (4, 3, "missing-accessible-name", "IconButton", None), (5, 3, "raw-value", "IconButton", "use a design token"), (6, 3, "raw-value", "IconButton", "use var(--white)"),
    ]
    assert rows(lint.usage_report(ws, df.limit(0))) == []
