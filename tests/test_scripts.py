"""The lexer of script files against facts written out by hand."""

import random
import time

import pytest

from tarnish.functions import scripts
from tarnish.operators import code


def of(source, *kinds, markup=True):
    return [f.name if f.name is not None else f.text for f in scripts.facts(source, markup) if f.kind in kinds]


@pytest.mark.parametrize(("source", "names"), [
    ('import React, { useState as us, type Foo } from "react";', ["react"]), ('import "side-effect"', ["side-effect"]), ("import type { T } from 'types';", ["types"]), ("import * as x from 'ns'", ["ns"]),
    ("import {\n  a, // 'c'\n  b,\n} from 'many'\nimport d from 'next'", ["many", "next"]), ("require('fs-extra').x(import('lodash/get'))", ["fs-extra", "lodash/get"]), ("a.require('x'); new require('y')", []),
    ("require('a' + b); require(`c`); require(d)", []), ("require('a', 1)", ["a"]), ("import fs = require('fs')", []), ("export { x } from 're'; export * from 'star'", []), ("import.meta.url; obj.import('x')", []),
    ("// import a from 'a'\n/* require('b') */", []), ("const s = \"import x from 'in'\", t = 'require(\"q\")'", []), ("`import y from 'z' ${require('inside')} ${`${import('deep')}`} require('no')`", ["inside", "deep"]),
    (r"const r = /require('a')[/']\/ '/g; require('b')", ["b"]), ("x = a / b; require('c') / d", ["c"]), ("if (x) /require('no')/.test(y); require('d')", ["d"]), ("f(x) / require('e') / 2", ["e"]),
    ("<A b='require(\"x\")'>it's {require('f')} // {/* require('no') */}</A>; require('g')", ["f", "g"]), ("a < b; require('h')", ["h"]), ("const f = <T,>(x: T) => x; require('i')", ["i"]),
    ("<><B.C {...p} /></>; require('j')", ["j"]), ("#!/usr/bin/env node\nrequire('k')", ["k"]), ("'unclosed\nrequire('l')", ["l"]), ("`unclosed ${require('m')", ["m"]), ("", []), ("/*", []), ("}}}) require('n')", ["n"]),
])
def test_imports(source, names):
    assert of(source, "import") == names


def test_typed_files_have_no_elements():
    source = "const f = <T>(x: T): T => <T>x; require('a')"
    assert of(source, "import", markup=False) == ["a"]


@pytest.mark.parametrize(("source", "symbols"), [
    ("function a() {}\nasync function b() {\n}\nexport function* c() {}", [("a", 1, 1, False), ("b", 2, 3, False), ("c", 4, 4, True)]),
    ("export default function Main() {}", []), ("if (x) { function inner() {} const g = () => 1 }", []), ("namespace N { export function h() {} }", [("h", 1, 1, True)]),
    ("const a = () => 1, b = function () { return 1 }\nlet c = async x =>\n  x + 1\nvar d = 1", [("a", 1, 1, False), ("b", 1, 1, False), ("c", 2, 3, False)]),
    ("export const f = (t: string): Promise<{ a: b }> => g(t);", [("f", 1, 1, True)]), ("const m = memo(() => 1), n = c ? () => 1 : 2", []), ("const w = (() => 1)", [("w", 1, 1, False)]),
    ("const k = (() => 1) as X", []), ("const z = (() => 1)()", []), ("const F: FC<P> = ({ a }) => {\n return a\n}", [("F", 1, 3, False)]), ("function sig(x: string): void;\nfunction sig(x: any) { }", [("sig", 2, 2, False)]),
    ("export async function load<T>(x: T): Promise<{ a: string }> {\n  return x;\n}", [("load", 1, 3, True)]), ("const s = `() => ${() => 1}`", []), ("function f(\n  a = '}',\n) { return /}/ }", [("f", 1, 3, False)]),
])
def test_symbols(source, symbols):
    found = [f for f in scripts.facts(source) if f.kind in ("function", "component")]
    assert [(f.name, f.line, f.line_end, f.exported) for f in found] == symbols
    for f in found:
        assert f.kind == ("component" if f.name[0].isupper() else "function") and f.text == "\n".join(source.split("\n")[f.line - 1 : f.line_end])


@pytest.mark.parametrize(("source", "names"), [
    ("function a(p, { q }, ...r) { b(p2) }", ["b", "p2"]), ("x.y.z?.w", ["x"]), ("f({ key: value, short, method(t) { return u } })", ["f", "short", "u", "value"]), ("const { a, b: c, ...d } = props", ["props"]),
    ("const g = (h, i) => j; k => l", ["j", "l"]), ("<Panel x={other}><div><N.M /></div></Panel>", ["Panel", "other"]), ("export { m as n, o }; export { p } from 'q'", ["m", "o"]), ("r = s; t += u", ["s", "t", "u"]),
    ("import v from 'v'; // v()", []), ("'w' + `x ${y}`", ["y"]), ("class Z extends A { b() { return this.c } }", ["A"]), ("try { d() } catch (e) { }", ["d"]), ("lab: for (const f of g) { }", ["g"]),
])
def test_references(source, names):
    assert of(source, "reference") == names


def test_import_and_export_lines():
    source = "import a from 'a'\n  export const b = 1;\nexport default c\nexport * from 'd'\nexport * as e from 'e'; x()\nexport {\n f }\nexport type T = 1"
    assert of(source, "line") == ["import a from 'a'", "export const b = 1;", "export * as e from 'e'; x()", "export {", "export type T = 1"]


@pytest.mark.parametrize("part", ["<a ", "/[ ", "`${", "/* ", "a ? ", "((", "const x = (", "import {", "import a,", "const a = (x): ", "function f(x): ", "<T ", "'\\", "`", "{", "export {", "=> ", "a\n"])
def test_time_is_linear_whatever_is_left_open(part):
    began = time.perf_counter()
    list(scripts.facts(part * 60_000))
    assert time.perf_counter() - began < 8


def test_no_text_stops_it():
    rng = random.Random(4)
    signs = ["`", "${", "}", "{", "(", ")", "<", ">", "</", "/>", "/", "'", '"', "\\", "\n", "a", " ", "=>", "import", "export", "const", "function", "from", "'x'", "=", ":", ",", "async", "[", "]", "*", "."]
    for _ in range(3000):
        list(scripts.facts("".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))))


def test_facts_as_a_table(spark):
    files = spark.createDataFrame([("r", "a.tsx", "import x from '@s/p/q'\nexport const F = () => <G/>"), ("r", "b.ts", "const f = <T>(x: T) => x"), ("r", "c.js", None), ("r", "d.js", "")], "repo string, path string, content string")
    assert {tuple(r) for r in code.script_imports(files).collect()} == {("r", "a.tsx", "@s/p")}
    assert {tuple(r) for r in code.script_symbols(files).collect()} == {("r", "a.tsx", 2, "F", True, "component"), ("r", "b.ts", 1, "f", False, "function")}
    assert {(r["path"], r["name"]) for r in code.script_references(files).collect()} == {("a.tsx", "G"), ("b.ts", "T"), ("b.ts", "x")}
    many = spark.createDataFrame([("r", "m.js", "\n".join(f"import a{k} from 'p{k}'" for k in range(50)))], "repo string, path string, content string")
    assert code.import_lines(many).first()["lines"] == [f"import a{k} from 'p{k}'" for k in range(40)]
    code.register_script_facts(spark)
    assert spark.sql("SELECT name FROM script_facts('require(\"a\")', true) WHERE kind = 'import'").first()["name"] == "a"


def test_files_are_spread_and_read_once(spark):
    from tarnish.plans import scripts as plans

    sf = "/root/testdata/sf0.001"
    assert plans.script_files(spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "PythonUDTF" not in spark._jvm.PythonSQLUtils.explainString(plans.script_dead_code(spark, sf)._jdf.queryExecution(), "simple")


def test_long_comments_strings_and_templates_are_read_to_their_ends():
    long = "x * y ' $ \\\\ " * 20_000
    source = f"/* {long} **/ import a from 'a';\nconst s = \"{long}\";\nconst t = `{long} ${{require('b')}}`; /* {long}"
    assert [(f.name, f.line) for f in scripts.facts(source) if f.kind == "import"] == [("a", 1), ("b", 3)]
