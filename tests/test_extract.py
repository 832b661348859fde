"""Extraction on small hand-written sources: one text per language, then odd inputs."""

from __future__ import annotations

PY = '''"""Module doc."""
from __future__ import annotations
import os, sys as system
from typing import (
    List,  # one
    Optional as Opt,
)
from abc import *
from . import sibling
MAX_RETRIES = 3; second = "a;b"
x: int = 5
pi = -3.14
a, b = 1, 2
class Base:
    """Base.

    More (text).
    """
    size: int = 4
    tag = "x#y"

    def __init__(self, name: str, *args, other: Dict[str, int] = {"a": (1,2)}, **kw):
        def inner(): pass

    @property
    def hidden(self): return 1

    async def get(self, /, key, *, n=3) -> str:
        \'\'\'
          Get it.
            Deep.
        \'\'\'
        return "}"

class Color(enum.Enum):
    RED = 1
    GREEN = "g"
    BLUE = auto()

class One(Base, Generic[K, V], metaclass=M): pass

@deco
class Skipped:
    pass

if True:
    import hidden
def run(a, c="(,", d: Callable[[int], str] = None): return 1
def doc():
    "Run it."
'''

JS = r"""
import React from 'react';
import { useState, useEffect as ue } from "react"
import * as utils from './utils';
import { default as ReactDOM } from 'react-dom';
import 'side';
/** Doc of add. {weird (
 * second line
 */
async function add(a, b = {x: 1}, ...rest) {
  if (a) { return `t ${b} {`; }
}
// plain
function noDoc({a, b}, [c]) { return /[{"]/.test(a); }
const MAX = 3, cfg = {
  key: 'secret',
  n: 5
};
let cur = null
var old = 'deprecated'
const mul = (a, b) => a * b; // trailing
glob = async (p, q) => { return p }
/**
 * User.
 * @class
 */
class User extends mixin(Base, Q) {
  static count = 0;
  #priv = () => { a(); };
  /**
   * Make.
   */
  constructor(name, age = 3) { this.n = name; }
  get full() { return 1 } set full(v) { }
  static async *create(n) {
    return new User(n);
  }
}
export const VERSION = '1.0', W = 2;
export function helper() { return true; }
export { helper as util, x };
export { y } from './y';
export * from 'all';
export default class Main {}
function* gen() {}
"""

CPP = r"""
#ifndef H
#define H(x) do { \
   foo(x) }
#include <iostream>
  #include "utils/helper.hpp"  // c
const int MAX_SIZE = 100;
static int counter = 0;
extern int global_var;
int numbers[10];
int filled[] = {1, 2};
std::vector<std::string> names;
auto result = calc(1, 2);
unsigned long total;
/**
 * Person class (a
 * human).
 */
class Person {
private:
    std::string name;
    int age = 3;
public:
    Person(const std::string& n, int a) : name(n), age(a) {}
    ~Person();
    // First line
    // second line
    std::string getName() const {
        return name;
    }
    T& operator[](int i) { return elements[i]; }
    class Deep { enum E1 { P, Q }; };
};
class Employee : public Person, Other<int> {
    std::string department;
};
// Adds.
int add(int a, int b) { return a + b; }
template<typename T>
T max(T a, T b) { return (a > b) ? a : b; }
void proc(const std::vector<int>& data, std::map<int, int> *p, int arr[], double y = 1.0, ...) { }
int* ptr(int a) { return 0; }
void Foo::bar() {}
enum class Status : int { OK = 0, BAD };
namespace A { namespace B {
  void util() {}
} }
#endif
"""

JL = r"""
using LinearAlgebra
using DataFrames: DataFrame, select
import JSON, A.B
using ..Parent
"Add (two)."
function add(x, y)
    a = [z for z in 1:3 if z > 1][end]
    function inner(q)
       for i in 1:3
          h(r) = r + 1
       end
    end
    return x' + y
end
function multiply(x::Int, y::Vector{Float64}; mode="(", args...)::Float64 where T
end
square(x) = x^2
map(xs) do x
   x + 1
end
mutable struct Dog{T} <: Animal
    name::String; kinds::Vector{Int}
    Dog(r) = r > 0 ? new(r) : error("end")
end
abstract type Animal end
const PI2 = 3.14
Vec = Vector{Float64}
a, b = 1, 2
macro twice(ex)
    quote
        $ex
    end
end
module M
function held(x)
end
module Deep
  const D = 4
end
end
"""


def by_name(items):
    return {x["name"]: x for x in items}


def params(f):
    return [(p["name"], p["type"]) for p in f["parameters"] or []]


def test_python(analysed):
    r = analysed(("a.py", PY))["a.py"]
    assert r["failure"] is None
    assert [(i["name"], i["source"], i["items"]) for i in r["imports"]] == [
        ("os", "os", None),
        ("system", "sys", None),
        ("typing", "typing", ["List", "Opt"]),
        ("abc", "abc", ["*"]),
        (".", ".", ["sibling"]),
    ]
    classes = by_name(r["classes"])
    assert list(classes) == ["Base", "One"]
    assert classes["Base"]["docstring"] == "Base.\n\n    More (text)."
    assert [b["name"] for b in classes["One"]["bases"]] == ["Base"]
    methods = by_name(classes["Base"]["methods"])
    assert list(methods) == ["__init__", "get"]
    assert params(methods["__init__"]) == [
        ("self", None), ("name", "str"), ("args", None), ("other", "Dict[str, int]"), ("kw", None),
    ]
    assert params(methods["get"]) == [("self", None), ("key", None), ("n", None)]
    assert methods["get"]["docstring"] == "Get it.\n  Deep."
    assert [(a["name"], a["type"]) for a in classes["Base"]["attributes"]] == [("size", "int"), ("tag", None)]
    assert [(m["name"], m["value"]) for m in r["enums"][0]["members"]] == [
        ("RED", "1"), ("GREEN", "g"), ("BLUE", "auto()"),
    ]
    functions = by_name(r["functions"])
    assert list(functions) == ["run", "doc"]
    assert params(functions["run"]) == [("a", None), ("c", None), ("d", "Callable[[int], str]")]
    assert functions["doc"]["docstring"] == "Run it."
    assert [(v["name"], v["kind"], v["value"]) for v in r["variables"]] == [
        ("MAX_RETRIES", "constant", "3"),
        ("second", "external_variable", "a;b"),
        ("x", "external_variable", "5"),
        ("pi", "external_variable", None),
    ]


def test_javascript(analysed):
    r = analysed(("a.js", JS))["a.js"]
    assert r["failure"] is None
    rows = [(i["name"], i["source"], i["items"]) for i in r["imports"]]
    assert rows == [
        ("React", "react", None),
        (None, "react", ["useState", "ue"]),
        ("utils", "./utils", ["*"]),
        ("ReactDOM", "react-dom", None),
        (None, "side", None),
        ("VERSION", "self", ["VERSION"]),
        ("W", "self", ["W"]),
        ("helper", "self", ["helper"]),
        (None, "self", ["util", "x"]),
        ("./y", "./y", ["y"]),
        ("all", "all", ["*"]),
        ("Main", "Main", ["default"]),
    ]
    functions = by_name(r["functions"])
    assert list(functions) == ["add", "noDoc", "glob"]
    assert [p for p, _ in params(functions["add"])] == ["a", "b", "...rest"]
    assert functions["add"]["docstring"] == "Doc of add. {weird (\nsecond line"
    assert functions["noDoc"]["docstring"] is None
    assert [p for p, _ in params(functions["noDoc"])] == ["{a, b}", "[c]"]
    user = r["classes"][0]
    assert (user["name"], user["bases"][0]["name"], user["docstring"]) == ("User", "mixin(Base, Q)", "User.\n@class")
    assert [m["name"] for m in user["methods"]] == ["constructor", "full", "full", "create"]
    assert user["methods"][0]["docstring"] == "Make."
    assert [(a["name"], a["static"]) for a in user["attributes"]] == [("count", True), ("#priv", False)]
    values = {v["name"]: (v["kind"], v["value"]) for v in r["variables"]}
    assert values["MAX"] == ("constant", "3")
    assert values["cfg"][1].startswith("{\n  key: 'secret'")
    assert values["cur"] == ("external_variable", "null")
    assert values["old"] == ("external_variable", "deprecated")
    assert values["mul"] == ("constant", "(a, b) => a * b")


def test_cpp(analysed):
    r = analysed(("a.cpp", CPP))["a.cpp"]
    assert r["failure"] is None
    assert [i["source"] for i in r["imports"]] == ["iostream", "utils/helper.hpp"]
    classes = by_name(r["classes"])
    assert list(classes) == ["Person", "Employee", "Deep"]
    assert classes["Person"]["docstring"] == "Person class (a\nhuman)."
    assert [m["name"] for m in classes["Person"]["methods"]] == ["Person", "getName"]
    assert classes["Person"]["methods"][1]["docstring"] == "First line\nsecond line"
    assert [(a["name"], a["type"]) for a in classes["Person"]["attributes"]] == [("name", "std::string"), ("age", "int")]
    assert [(b["name"], b["access"]) for b in classes["Employee"]["bases"]] == [("Person", "public"), ("Other<int>", "private")]
    functions = by_name(r["functions"])
    assert list(functions) == ["add", "max", "proc", "util"]
    assert functions["add"]["docstring"] == "Adds."
    assert params(functions["proc"]) == [
        ("data", "std::vector<int>&"), ("p", "std::map<int, int>*"), ("arr", "int[]"), ("y", "double"), ("...", "..."),
    ]
    assert [(v["name"], v["kind"], v["type"], v["value"]) for v in r["variables"]] == [
        ("MAX_SIZE", "constant", "const int", "100"),
        ("counter", "external_variable", "static int", "0"),
        ("global_var", "external_variable", "extern int", None),
        ("filled", "external_variable", "int[]", "{1, 2}"),
        ("names", "external_variable", "std::vector<std::string>", None),
        ("result", "external_variable", "auto", "calc(1, 2)"),
        ("total", "external_variable", "unsigned long", None),
    ]
    enums = by_name(r["enums"])
    assert [(m["name"], m["value"]) for m in enums["Status"]["members"]] == [("OK", "0"), ("BAD", None)]
    assert "E1" in enums


def test_julia(analysed):
    r = analysed(("a.jl", JL))["a.jl"]
    assert r["failure"] is None
    assert [(i["source"], i["items"]) for i in r["imports"]] == [
        ("LinearAlgebra", None), ("DataFrames", ["DataFrame", "select"]), ("JSON", None), ("A.B", None),
    ]
    functions = {(f["name"], f["origin"]): f for f in r["functions"]}
    assert set(functions) == {
        ("add", "top"), ("multiply", "top"), ("square", "top"), ("@twice", "top"), ("held", "module"),
        ("inner", "nested"), ("h", "nested"),
    }
    assert functions["add", "top"]["docstring"] == "Add (two)."
    assert params(functions["multiply", "top"]) == [("x", "Int"), ("y", None), ("mode", None)]
    dog = r["classes"][0]
    assert (dog["name"], dog["bases"][0]["name"]) == ("Dog", "Animal")
    assert [(a["name"], a["type"]) for a in dog["attributes"]] == [("name", "String"), ("kinds", None)]
    assert [m["name"] for m in dog["methods"]] == ["Dog"]
    assert [(v["name"], v["kind"], v["value"]) for v in r["variables"]] == [
        ("PI2", "constant", "3.14"), ("Vec", "type_alias", None),
    ]


def test_damaged_files_give_a_reason(analysed):
    r = analysed(
        ("a.py", "def f(\n  print('x'\n"),
        ("b.py", "x = 'abc\n"),
        ("c.cpp", "class I { int x\n // m\n"),
        ("d.jl", "function broken(\n  # nothing closes it\n"),
        ("e.jl", "using A\nfunction f(x)\n if x\nend\nconst K = 3\n"),
        ("f.py", "x = " + "(" * 80 + ")" * 80),
        ("dir/.py", "import os"),
        ("g.py", ""),
        ("h.py", None),
    )
    assert "syntax error" in r["a.py"]["failure"]
    assert "unterminated" in r["b.py"]["failure"]
    assert "syntax error" in r["c.cpp"]["failure"]
    assert "syntax error" in r["d.jl"]["failure"]
    assert r["e.jl"]["failure"] is None and r["e.jl"]["recovered"]
    assert [f["name"] for f in r["e.jl"]["functions"]] == ["f"]
    assert r["f.py"]["failure"] is None and [v["name"] for v in r["f.py"]["variables"]] == ["x"]
    assert r["dir/.py"]["failure"] == "no supported suffix"
    assert r["g.py"]["failure"] is None and r["g.py"]["imports"] == []


def test_nesting_of_any_depth(analysed):
    n = 500
    groups = "(" * n + "1, 2" + ")" * n
    lists = "[" * n + "3" + "]" * n
    r = analysed(
        ("a.py", f"import os\nX = {lists}\ndef f(a={groups}, b: int = 2):\n    'doc'\nclass C:\n    y = {groups}\n    def m(self, z): return {lists}\n"),
        ("a.js", f"import a from 'b';\nconst x = {lists};\nfunction f(p, q = {groups}) {{ {'if (p) { ' * n}{'}' * n} }}\nclass C {{ m(z) {{ {'{' * n}{'}' * n} }} }}\n"),
        ("a.cpp", f"#include <map>\nint x = {groups};\nint f(int a) {{ {'{' * n}{'}' * n} return 1; }}\n" + "namespace n {\n" * 40 + "class C { int v; };\nint g(char c);\n" + "}\n" * 40 + "".join(f"struct S{i} {{ int v{i};\n" for i in range(30)) + "};\n" * 30),
        ("a.jl", f"using A\nconst X = {lists}\nfunction f(a, b={groups})\n" + "  if a\n" * n + "  inner(x) = x + 1\n" + "  end\n" * n + "end\ng(y) = y\n"),
        ("bad.py", "x = " + "(" * n + ")" * (n - 1)),
    )
    assert [r[p]["failure"] for p in ("a.py", "a.js", "a.cpp", "a.jl")] == [None] * 4
    assert "unbalanced" in r["bad.py"]["failure"]
    py = r["a.py"]
    assert [v["name"] for v in py["variables"]] == ["X"]
    assert [p["name"] for p in py["functions"][0]["parameters"]] == ["a", "b"] and py["functions"][0]["docstring"] == "doc"
    assert [m["name"] for m in py["classes"][0]["methods"]] == ["m"] and py["classes"][0]["attributes"][0]["name"] == "y"
    js = r["a.js"]
    assert [f["name"] for f in js["functions"]] == ["f"] and [p["name"] for p in js["functions"][0]["parameters"]] == ["p", "q"]
    assert [v["name"] for v in js["variables"]] == ["x"] and [m["name"] for m in js["classes"][0]["methods"]] == ["m"]
    cpp = r["a.cpp"]
    assert [i["name"] for i in cpp["imports"]] == ["map"] and [f["name"] for f in cpp["functions"]] == ["f", "g"]
    assert [c["name"] for c in cpp["classes"]] == ["C", *[f"S{i}" for i in range(30)]]
    assert [v["name"] for v in cpp["variables"]] == ["x"] and cpp["variables"][0]["value"] is None or groups in cpp["variables"][0]["value"]
    jl = r["a.jl"]
    assert [f["name"] for f in jl["functions"]] == ["f", "g", "inner"] and [p["name"] for p in jl["functions"][0]["parameters"]] == ["a", "b"]


def test_long_files_do_not_exhaust_the_stack(analysed):
    n = 5000
    r = analysed(
        ("a.py", "class A:\n" + "".join(f"    def m{i}(self, a={{'k': [1, 2]}}): return '(' \n" for i in range(n))),
        ("a.js", "class A {\n" + "".join(f"  m{i}(a) {{ if (a) {{ b('{{'); }} }}\n" for i in range(n)) + "}\n"),
        ("a.cpp", "/* " + "x * y\n" * n + "*/\n" + "".join(f"int v{i} = f({i}, {{1}});\n" for i in range(n))),
        ("a.jl", "".join(f"function f{i}(x)\n  if x\n    y[end]\n  end\nend\n" for i in range(n))),
        ("s.py", 'x = """' + "a\\n'\n" * n + '"""\n'),
    )
    assert len(r["a.py"]["classes"][0]["methods"]) == n
    assert len(r["a.js"]["classes"][0]["methods"]) == n
    assert len(r["a.cpp"]["variables"]) == n
    assert len(r["a.jl"]["functions"]) == n
    assert len(r["s.py"]["variables"]) == 1


def test_unicode_and_line_ends(analysed):
    r = analysed(("a.py", "import ö\r\nname = 'é🙂'\r\ndef größe(x):\r\n    'Länge'\r\n"))["a.py"]
    assert r["imports"][0]["source"] == "ö"
    assert r["variables"][0]["value"] == "é🙂"
    assert (r["functions"][0]["name"], r["functions"][0]["docstring"]) == ("größe", "Länge")


def test_template_arguments_of_any_depth(analysed):
    def deep(n):
        return "A<" * n + "int, B<char>" + ">" * n

    code = f"int first(std::vector<int> v);\nstruct S {{\n  {deep(9)} nine;\n  {deep(10)} ten;\n  {deep(40)} forty;\n}};\nint run({deep(10)} x, {deep(25)} y, int z);\n"
    r = analysed(("a.cpp", code))["a.cpp"]
    assert r["failure"] is None
    (cls,) = r["classes"]
    assert [(a["name"], a["type"]) for a in cls["attributes"]] == [("nine", deep(9)), ("ten", deep(10)), ("forty", deep(40))]
    first, run = r["functions"]
    assert params(first) == [("v", "std::vector<int>")]
    assert params(run) == [("x", deep(10)), ("y", deep(25)), ("z", "int")]


def test_pattern_literals_after_any_blanks(analysed):
    code = "const r =          /[(]/;\nconst s =\t \t  \t /\"/g;\nfunction f(a) {\n  return      /[{]'/;\n}\nlet half = a    /  2;\nconst n =      3; // ( note\n"
    r = analysed(("a.js", code))["a.js"]
    assert r["failure"] is None
    assert [f["name"] for f in r["functions"]] == ["f"]
    assert [v["name"] for v in r["variables"]] == ["r", "s", "half", "n"]
