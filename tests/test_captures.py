"""What each language's keys capture in small, freshly written sources."""

from __future__ import annotations

import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from quarry.capture.extract import with_captures
from quarry.capture.profiles import PROFILES, extract, find_profile, select, sql_dialect, supported_keys


def got(lang: str, key: str, text: str) -> list[str]:
    return [t for _, t, _ in extract(find_profile(lang), text, (key,))]


RUST = '''
use std::collections::{HashMap, BTreeMap};
// fn not_me() "no"
/* outer /* inner fn x() */ still */
pub struct Point<'a> { x: &'a str }
enum Shape { Round, Square(char) }
trait Area { fn area(&self) -> f64; }
impl<'a> Area for Point<'a> { fn area(&self) -> f64 { self.x.len() as f64; helper('x') } }
impl Shape { pub async fn grow(&mut self) {} }
type Pair = (u8, u8);
mod inner { }
macro_rules! twice { ($x:expr) => { $x } }
fn helper(c: char) -> f64 { println!("say \\"{}\\"", r#"raw "q" fn"#); vec![1]; f64::from(1u8) }
'''
PYTHON = '''
import os, sys
from a.b import (
    c,
    d,
)
# class Fake: def nope()
class Real(Base):
    """doc def inner()"""
    async def method(self, x=r"raw \\d"):
        return self.other(x) + helper("text") if x else f'{x}'
def helper(y): return os.path.join(y)
'''
SCRIPT = '''
import fs from "fs";
import { a,
  b } from './m';
// class No {}
class Store extends Base { constructor(x) { super(x); } load(id) { return this.fetch(id); } static async make() {} }
export function build(x) { const r = /ab+c/g; return new Store(`t ${x + `in ${1}`}`); }
export const useThing = (a) => { const [s, t] = useState(0); return a / 2 / 3; };
function useOther() { user(); }
if (x) { run(); }
'''
TYPED = '''
import { X } from "x";
interface Shape { area(): number; }
type Name = string | number;
enum Level { Low, High }
export class Box<T> implements Shape { area(): number { return compute<T>(this.x); } }
export function make(): Box<string> { return new Box<string>(); }
'''
REACT = '''
import React, { useState } from "react";
export const Card = ({ title }) => {
  const [open, setOpen] = useState(false);
  return <div className="card" onClick={() => setOpen(!open)}><Title.Big text={title} {...rest} /><Button disabled>Hi</Button></div>;
};
export const Wrapped = React.memo(Card);
function App() { return a < b ? <Card title="x" /> : null; }
class Old extends React.Component { render() { return <p>hi</p>; } }
const useData = () => useMemo(() => 1);
'''
GO = '''
package main
import (
    "fmt"
    m "math"
)
import "os"
type Point struct { X int }
type Reader interface { Read() }
type (
    ID int
    Box struct { v ID }
)
// func no()
func (p *Point) Move(d int) { fmt.Println("moved", `raw`) }
func main() { helper(1); p.Move(2) }
'''
JAVA = '''
import java.util.List;
import static a.B.c;
/** class Doc */
public class Shop<T> implements Sells {
    private int n;
    public Shop(int n) { this.n = n; }
    public List<T> sell(String who) throws Exception { return api.call(who, "text"); }
    abstract void later(int x);
    enum Kind { A, B }
}
interface Sells { void sell(String who); }
class Use { void go() { Shop<String> s = new Shop<>(1); if (ok()) { } } }
'''
C = '''
#include <stdio.h>
#include "own.h"
#define LIMIT 10
#define SQUARE(x) ((x) * (x))
/* int fake(void) { } */
typedef unsigned long word;
typedef struct node { int v; } node_t;
union value { int i; };
enum color { RED };
static int add(int a, int b) { return a + b; }
char *name(void) { printf("hi %d", add(1, 2)); return "x"; }
'''
CPP = '''
#include <vector>
class Shape { public: Shape(int n) { } virtual double area() const { return 0; } };
struct Point { int x; };
enum class Level { Low };
namespace geo { int count(const std::vector<int>& v) { return std::max(v.size(), total(v)); } }
const char* raw = R"x(raw "text")x";
'''
CSHARP = '''
using System;
using System.Linq;
namespace Shop.Core {
    public interface ISell { void Sell(string who); }
    public class Store : ISell {
        public Store(int n) { }
        public void Sell(string who) { Console.WriteLine($"sold {who}"); Log(@"c:\\x"); }
        public int Twice(int x) => x * 2;
    }
    public struct P { } public enum Kind { A }
}
'''
PHP = '''<?php
namespace App;
use App\\Models\\User;
# comment class No
interface Sells {} trait Logs {} class Shop { public function sell($x) { return $this->api->call($x, "t"); } }
function helper($y) { return strlen('abc'); }
'''
RUBY = '''
require 'json'
# class No
module Shop
  class Store < Base
    def self.make(x) = new(x)
    def sell!(who)
      puts "sold #{who}"
      api.call(who)
    end
  end
end
'''
BASH = '''#!/bin/bash
# greet nobody
greet() { echo "hello $1"; }
function leave { exit 1; }
for f in a b; do greet "$f" | sort; done
'''
LUA = '''
-- function no()
--[[ long
comment ]]
local m = require("mod")
function M.run(x) return helper(x, [[raw]]) end
local function helper(y) print('s') end
'''
SCALA = '''
import a.b.{C, D}
object Main extends App { def run(x: Int): Int = helper.twice(x) + 1 }
case class Point(x: Int)
trait Area { def area: Double }
// object No
'''
SWIFT = '''
import Foundation
protocol Shape { func area() -> Double }
class Box: Shape { func area() -> Double { return compute(1, "s").rounded() } }
// class No
'''
SQL = '''
-- create table no
CREATE TABLE IF NOT EXISTS shop.items (id int, note text DEFAULT 'x');
CREATE OR REPLACE VIEW v AS SELECT count(*) FROM shop.items i JOIN users u ON u.id = i.id;
CREATE FUNCTION total(a int) RETURNS int LANGUAGE sql AS 'select 1';
INSERT INTO logs VALUES (now());
'''
HTML = '''<!DOCTYPE html><html><head><link rel="x"><script>var a = "<p>not</p>";</script></head>
<body><!-- note --><p class="a">Hello <b>there</b></p><br/></body></html>'''
CSS = '''@import url("a.css");
/* .no */
.card, #main > .title:hover { color: red; font: "Arial", bold; background: url(x.png); }
@media screen { .wide { margin: auto } }
'''

CASES = [
    ("rs", RUST, {"struct": ["Point"], "enum": ["Shape"], "trait": ["Area"], "impl": ["Point", "Shape"], "type": ["Pair"], "module": ["inner"], "macro": ["twice"], "def": ["Point", "Shape", "Area", "Pair", "inner"], "func": ["area", "area", "grow", "helper"], "import": ["use std::collections::{HashMap, BTreeMap};"], "comment": ['// fn not_me() "no"', "/* outer /* inner fn x() */ still */"]}),
    ("py", PYTHON, {"class": ["Real"], "func": ["method", "helper"], "def": ["Real", "method", "helper"], "import": ["import os, sys", "from a.b import (\n    c,\n    d,\n)"], "call": ["other", "helper", "join"], "comment": ["# class Fake: def nope()"], "str": ['"""doc def inner()"""', 'r"raw \\d"', '"text"', "f'{x}'"]}),
    ("js", SCRIPT, {"class": ["Store"], "func": ["constructor", "load", "make", "build", "useOther"], "import": ['import fs from "fs";', "import { a,\n  b } from './m';"], "comment": ["// class No {}", "/ab+c/g"], "str": ['"fs"', "'./m'", "`t ${x + `in ${1}`}`"], "hook": ["useState", "user"], "customhook": ["useThing", "useOther"], "call": ["fetch", "Store", "useState", "user", "run"]}),
    ("ts", TYPED, {"interface": ["Shape"], "type": ["Name"], "enum": ["Level"], "class": ["Box"], "def": ["Shape", "Name", "Level", "Box"], "func": ["area", "make"], "call": ["compute", "Box"]}),
    ("tsx", REACT, {"component": ["Card", "Wrapped", "App", "Old", "useData"], "element": ["div", "Title.Big", "Button", "Card", "p"], "prop": ["className", "onClick", "text", "disabled", "title"], "hook": ["useState", "useMemo"], "customhook": ["useData"]}),
    ("go", GO, {"type": ["Point", "Reader", "ID", "Box"], "struct": ["Point", "Box"], "interface": ["Reader"], "func": ["Move", "main"], "call": ["Println", "helper", "Move"], "import": ['import (\n    "fmt"\n    m "math"\n)', 'import "os"'], "str": ['"fmt"', '"math"', '"os"', '"moved"', "`raw`"]}),
    ("java", JAVA, {"class": ["Shop", "Use"], "interface": ["Sells"], "enum": ["Kind"], "func": ["Shop", "sell", "later", "sell", "go"], "call": ["call", "Shop", "ok"], "import": ["import java.util.List;", "import static a.B.c;"], "comment": ["/** class Doc */"], "str": ['"text"']}),
    ("c", C, {"func": ["add", "name"], "struct": ["node", "value"], "enum": ["color"], "type": ["word", "node_t"], "macro": ["LIMIT", "SQUARE"], "import": ["#include <stdio.h>\n", '#include "own.h"\n'], "call": ["printf", "add"], "str": ["<stdio.h>", '"own.h"', '"hi %d"', '"x"'], "comment": ["/* int fake(void) { } */"]}),
    ("cpp", CPP, {"class": ["Shape"], "struct": ["Point"], "enum": ["Level"], "func": ["Shape", "area", "count"], "call": ["std::max", "max", "size", "total"], "str": ["<vector>", 'R"x(raw "text")x"']}),
    ("cs", CSHARP, {"class": ["Store"], "interface": ["ISell"], "struct": ["P"], "enum": ["Kind"], "type": ["Shop"], "func": ["Sell", "Sell", "Twice"], "call": ["WriteLine", "Log"], "import": ["using System;", "using System.Linq;"], "str": ['$"sold {who}"', '@"c:\\x"']}),
    ("php", PHP, {"class": ["Shop"], "interface": ["Sells"], "trait": ["Logs"], "func": ["helper"], "import": ["App\\Models\\User"], "call": ['$this->api->call($x, "t")', "strlen('abc')"], "comment": ["# comment class No"]}),
    ("rb", RUBY, {"class": ["Store"], "module": ["Shop"], "func": ["make", "sell!"], "def": ["Shop", "Store", "make", "sell!"], "call": ["require", "new", "puts", "call"], "comment": ["# class No"], "str": ["'json'", '"sold #{who}"']}),
    ("sh", BASH, {"func": ["greet", "leave"], "call": ['echo "hello $1"', "exit 1", 'greet "$f"', "sort"], "comment": ["#!/bin/bash", "# greet nobody"], "str": ['"hello $1"', '"$f"']}),
    ("lua", LUA, {"func": ["M.run", "helper"], "call": ["require", "helper", "print"], "comment": ["-- function no()", "--[[ long\ncomment ]]"], "str": ['"mod"', "[[raw]]", "'s'"]}),
    ("scala", SCALA, {"class": ["Point"], "object": ["Main"], "type": ["Main"], "trait": ["Area"], "func": ["run", "area"], "import": ["import a.b.{C, D}"], "call": ["helper.twice(x)"], "comment": ["// object No"]}),
    ("swift", SWIFT, {"class": ["Box"], "protocol": ["Shape"], "func": ["area", "area"], "import": ["import Foundation"], "comment": ["// class No"], "str": ['"s"']}),
    ("ex", "defmodule Shop do\n  # note\n  def sell(x), do: IO.puts(\"s\")\nend\n", {"def": ["defmodule", "Shop", "do", "def", "sell", "x", "do", "IO", "puts", "end"], "comment": ["# note"], "str": ['"s"']}),
    ("hs", "module Shop.Core where\n-- note\n{- a {- b -} -}\nsell x = helper x \"s\"\n", {"func": ["sell", "x", "helper", "x"], "module": ["Shop.Core"], "comment": ["-- note", "{- a {- b -} -}"], "str": ['"s"']}),
    ("ml", "(* note (* in *) *)\nlet rec sell x = helper x \"s\"\nmodule M = struct let a = 1 end\n", {"func": ["sell", "a"], "comment": ["(* note (* in *) *)"], "module": ["module M = struct let a = 1 end"], "str": ['"s"']}),
    ("zig", "const std = @import(\"std\");\n// note\npub fn run(x: u8) void { std.debug.print(\"s\", .{x}); }\n", {"import": ["@import"], "func": ["std", "run", "x", "u8", "std", "debug", "print", "x"], "comment": ["// note"], "str": ['"std"', '"s"']}),
    ("html", HTML, {"def": ["html", "head", "link", "script", "body", "p", "b"], "import": ["link", "script"], "comment": ["<!-- note -->"], "str": ["Hello", "there"]}),
    ("css", CSS, {"def": ["card", "main", "title", "wide"], "type": ["card", "title", "wide"], "import": ['@import url("a.css");'], "comment": ["/* .no */"], "str": ['"a.css"', "red", '"Arial"', "bold", "auto"]}),
    ("sql", SQL, {"def": ["shop.items", "v", "total"], "func": ["total"], "call": ["count", "now"], "comment": ["-- create table no"], "str": ["'x'", "'select 1'"]}),
]


@pytest.mark.parametrize(("lang", "key", "text", "want"), [(lang, k, text, w) for lang, text, keys in CASES for k, w in keys.items()])
def test_captures(lang, key, text, want):
    assert got(lang, key, text) == want


def test_rust_calls_and_strings():
    assert {"len", "helper", "println", "vec", "from"} <= set(got("rs", "call", RUST)) and "grow" not in got("rs", "call", RUST)
    assert got("rs", "str", RUST) == ['"say \\"{}\\""', 'r#"raw "q" fn"#']


def test_sql_references():
    refs = got("sql", "import", SQL)
    assert {"shop.items", "users", "logs"} <= set(refs) and "no" not in refs


def test_positions_are_bytes_and_rows():
    (key, text, place), = extract(find_profile("py"), 'é = 1\n\tx = "ü"\n', ("str",))
    assert (key, text, place) == ("str", '"ü"', (12, 16, 1, 5, 1, 9))


def test_broken_sources_never_fail():
    for p in PROFILES:
        for text in ("", "(((", '"', "/*", "{-", "`${", "<div", "def", "class", "fn (", "}" * 50, "\x00\udcff".encode("utf-8", "replace").decode(), "'''", "#include", "import", "@", "<!--"):
            extract(p, text, tuple(p.finders))


def test_selection():
    assert select("PY", "").id == "py" and select("txt", "") is None and select("h", "") is None
    assert select(None, "#!/usr/bin/env python3\n").id == "py" and select(None, "#!/bin/sh\n").id == "sh" and select(None, "x") is None
    assert select("txt", "", "c++").id == "cpp" and find_profile("htm").id == "html"
    assert [sql_dialect(t)[0] for t in ("DELIMITER //", "begin  atomic", "RETURNS TABLE", "language plpgsql", "LANGUAGE PLPGSQL")] == ["sqlmysql", "sqlsqlite", "sqlpg", "sqlpg", "sql"]


def test_every_profile_has_its_keys():
    assert len(PROFILES) == 26 and sum(len(p.extensions) for p in PROFILES) == 37
    assert "str" not in supported_keys(find_profile("scala")) and "call" not in supported_keys(find_profile("html"))
    assert "func" not in supported_keys(find_profile("tsx"))


#: Texts of which more and more are put together, with a key that looks at all of them.
GROWING = {
    "tsx": ("prop", "<a \n"), "html": ("def", "<a "), "scala": ("call", "x.f(1).g(2)\n"), "swift": ("call", "x.f(1).g(2).h(3)\n"), "php": ("call", "$x->f(1)->g(2);\n"),
    "js": ("call", ".f(1)"), "py": ("func", "def f(a): return g(a)\n"), "rs": ("impl", "impl T for E { fn f() { g(1) } }\n"), "css": ("def", ".a, #b { c: d }\n"),
}


@pytest.mark.parametrize("language", GROWING)
def test_time_grows_with_the_text(language):
    key, piece = GROWING[language]
    p = find_profile(language)

    def took(n: int) -> float:
        text = ("<?php\n" if language == "php" else "x" if language == "js" else "") + piece * n
        best = 9e9
        for _ in range(2):
            began = time.process_time()
            extract(p, text, (key,))
            best = min(best, time.process_time() - began)
        return best

    assert took(4000) <= 8 * took(1000) + 0.2


def test_chains_tags_and_attributes_as_before():
    def found(language: str, key: str, text: str) -> list[str]:
        return [t for _, t, _ in extract(find_profile(language), text, (key,))]

    assert found("php", "call", "<?php $x->f(1)->g(2)->h($y->k(3));") == ["$x->f(1)", "$x->f(1)->g(2)", "$x->f(1)->g(2)->h($y->k(3))", "$y->k(3)"]
    assert found("tsx", "prop", "const a = <Box<string> kind='k' on={b}><br wide /></Box>;") == ["string", "wide"]
    assert found("html", "def", "<p title='a > b' x=\"<i>\">t</p><br/><a href=x/y>z</a><a <b>") == ["p", "a", "b"]
    assert found("html", "comment", "<p><!-- open") == ["<!-- open"]


def test_memory_does_not_grow_with_a_batch(spark):
    """A batch of Spark's is up to 10,000 files; what is held of their captures is that of a few."""

    class Files:
        schema = T.StructType.fromDDL("display_path string, ext string, text string, content_state string")

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    files = Files()
    with_captures(files, ("def",))
    texts = ["", None, *(f"<h1>é{k}</h1>\n" + "<p>text</p>" * 150 for k in range(700))]
    made = [["a.html"] * len(texts), ["html"] * len(texts), texts, ["loaded"] * len(texts)]
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in made], names=Files.schema.names)
    tracemalloc.start()
    rows = sum(out.num_rows for out in files.run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and peak < 40e6
    out = pa.Table.from_batches(files.run(iter([batch.slice(1, 40), batch.slice(0, 0)])))
    assert out.column_names == [*Files.schema.names, "profile", "supported", "captures", "exhausted"] and out["text"].to_pylist() == texts[1:41]
    for text, found in zip(texts[1:41], out["captures"].to_pylist()):
        assert [x["text"] for x in found] == (["h1", *["p"] * 150] if text else [])
        if text:
            line = len(text.partition("\n")[0].encode()) + 1
            assert found[0] == {"key": "def", "text": "h1", "range": {"start_byte": 1, "end_byte": 3, "start_row": 0, "start_col": 1, "end_row": 0, "end_col": 3}}
            assert found[1]["range"] == {"start_byte": line + 1, "end_byte": line + 2, "start_row": 1, "start_col": 1, "end_row": 1, "end_col": 2}
