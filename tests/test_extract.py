import pytest
from pyspark.sql import functions as F

from weftgraph.extract import entities as E
from weftgraph.extract import frameworks as W

JAVA = '''package a.b;
import c.Base;
import java.util.List;
/** Keeps boats. */
@Entity(name = "boat")
public class Boat extends Base implements Runnable {
    private Engine engine;
    int size = 3;
    static class Inner { }
    /** Starts it. @return nothing */
    @Override
    public void run(final String how, int... n) throws StormException {
        helper(); engine.start(); new Sail(); super.run(); Base.tie(); String s = "class Fake { void no() {} }";
    }
    void helper() { }
}
class StormException extends RuntimeException { }
'''
PY = '''"""Doc."""
import os.path as p
from x.y import Base, tool
LIMIT = 3
class A(Base, dict):
    kind: str = "a"
    @property
    def _name(self): return self.go(tool(1))
    def go(self, n: int = 1) -> str:
        """Goes.

        Args:
            n: how far
        """
        raise ValueError(p.join("def fake(): pass"))
class Colour(Enum):
    RED = 1
def main(): A().go()
'''
TS = '''import { Base, io as net } from './base';
@Injectable()
export class A extends Base<string> implements I {
  private size: Gauge = new Gauge();
  async open(door: string, n?: number): Promise<void> { net.send(door); this.close(); }
  close() { }
}
export interface I extends J { open(x: string): void }
export enum E { A }
export const f = (a: number): string => { return g(a); };
'''


def sheet(path, text):
    s = E.extract("p", path, text)
    assert not s.errors
    return {n["id"]: n for n in s.nodes}, {(e["source"], e["type"], e["target"]) for e in s.edges}


def test_java():
    n, e = sheet("src/main/java/a/b/Boat.java", JAVA)
    assert n["a.b"]["type"] == "package" and n["a.b.Boat"]["type"] == "class" and n["a.b.StormException"]["type"] == "exception"
    boat, run = n["a.b.Boat"], n["a.b.Boat.run"]
    assert (boat["start_line"], boat["end_line"], boat["description"], boat["modifiers"]) == (5, 16, "Keeps boats.", ["public"])
    assert boat["annotations"][0]["name"] == "@Entity" and boat["annotations"][0]["framework"] == "JPA" and boat["annotations"][0]["parameters"] == [{"name": "name", "value": '"boat"', "type": "string"}]
    assert (run["return_type"], [p["name"] for p in run["parameters"]], run["start_line"], run["end_line"]) == ("void", ["how", "n"], 11, 14)
    assert "a.b.Fake" not in n and n["a.b.Boat.engine"]["type"] == "field"
    assert {("a.b.Boat", "extends", "c.Base"), ("a.b.Boat", "implements", "java.lang.Runnable"), ("a.b.Boat", "belongs_to", "a.b"), ("a.b.Boat", "contains", "a.b.Boat.run"), ("a.b.Boat", "contains", "a.b.Boat.Inner"), ("a.b.Boat.engine", "references", "a.b.Engine"), ("a.b.Boat.run", "throws", "a.b.StormException"), ("a.b.Boat.run", "calls", "a.b.Boat.helper")} <= e
    assert not any(t == "a.b.size" or "int" in t.split(".") for _, k, t in e if k == "references")


def test_python():
    n, e = sheet("src/m/boat.py", PY)
    assert n["m.boat"]["type"] == "module" and n["m.boat.Colour"]["type"] == "enum" and n["m.boat.LIMIT"]["return_type"] == "int"
    assert n["m.boat.A._name"]["modifiers"] == ["private", "property"] and n["m.boat.A._name"]["annotations"][0]["category"] == "core"
    assert n["m.boat.A.go"]["description"] == "Goes." and n["m.boat.A.go"]["return_type"] == "str" and n["m.boat.main"]["type"] == "function"
    assert {("m.boat.A", "extends", "x.y.Base"), ("m.boat.A", "extends", "builtins.dict"), ("m.boat.A", "contains", "m.boat.A.kind"), ("m.boat.A._name", "calls", "m.boat.A.go"), ("m.boat.A._name", "calls", "x.y.tool"), ("m.boat.A.go", "calls", "os.path.join"), ("m.boat.A.go", "throws", "builtins.ValueError"), ("m.boat.main", "belongs_to", "m.boat")} <= e


def test_typescript():
    n, e = sheet("src/ui/a.ts", TS)
    assert {n[f"ui.a.{x}"]["type"] for x in ("A", "I", "E")} == {"class", "interface", "enum"} and n["ui.a.f"]["type"] == "function"
    assert n["ui.a.A"]["annotations"][0]["framework"] == "Angular" and [p["type"] for p in n["ui.a.A.open"]["parameters"]] == ["string", "number"] and n["ui.a.A.open"]["return_type"] == "Promise<void>"
    assert {("ui.a.A", "extends", "./base.Base"), ("ui.a.A", "implements", "ui.a.I"), ("ui.a.I", "extends", "ui.a.J"), ("ui.a.A.open", "calls", "./base.io.send"), ("ui.a.A.open", "calls", "ui.a.A.close"), ("ui.a.A.size", "references", "ui.a.Gauge")} <= e


@pytest.mark.parametrize("head", ["export class A", "export default class A", "class A", "export abstract class A"])
@pytest.mark.parametrize("path", ["src/ui/a.ts", "src/ui/a.js"])
def test_class_behind_a_long_decorator(path, head):
    if "abstract" in head and path.endswith("js"):
        pytest.skip("TypeScript only")
    long = "@NgModule({ imports: [" + ", ".join(f"M{i}" for i in range(90)) + "],\n  make: () => { go(1); } })\n"
    for text in (long + head, head.replace("class", long + "class", 1) if "default" in head else long + head):
        n, _ = sheet(path, f"go();\n/** Keeps boats. */\n{text} {{ }}\n")
        a = n["ui.a.A"]
        assert (a["start_line"], a["end_line"], a["description"], [x["name"] for x in a["annotations"]]) == (3, 5, "Keeps boats.", ["@NgModule"])
        assert "abstract" not in head or "abstract" in a["modifiers"]


@pytest.mark.parametrize("path, text", [("a.java", "class {"), ("a.py", "def f("), ("a.ts", "class A {"), ("a.rb", "x")])
def test_errors(path, text):
    s = E.extract("p", path, text)
    assert len(s.errors) == 1 and not s.nodes


def test_helpers():
    assert E.split_arguments('a, "b, c", [d, e], f(g, h)') == ["a", '"b, c"', "[d, e]", "f(g, h)"]
    assert [E.argument_type(x) for x in ('"a"', "true", "null", "-1.5", "{1}", "A.B")] == ["string", "boolean", "null", "number", "collection", "identifier"]
    d = E.documentation("/** Does it.\n * twice\n * @param x the x\n * goes on\n * @return y */")
    assert d == {"": ["Does it.", "twice"], "param": ["x the x goes on"], "return": ["y"]}
    kinds = [(c["target"], c["kind"]) for c in E.calls("foo(); a.bar(); new Baz(); Util.q(); super.z(); if (x) {}", "java", {"Util": "k.Util"}, {"foo": "K.foo"})]
    assert kinds == [("K.foo", "function"), ("bar", "instance"), ("Baz", "constructor"), ("k.Util.q", "static"), ("z", "super")]


def test_scan(spark):
    rows = [("p", "src/main/java/a/b/Boat.java", JAVA), ("p", "src/main/java/a/b/Boat.java", JAVA), ("p", "x.py", "def f("), ("p", "e.py", ""), ("p", None, "x"), ("q", "n.py", None)]
    g, errors = E.scan(spark.createDataFrame([(*r, 1) for r in rows], "project_id string, source_file string, text string, kind int"))
    assert g.nodes.where("id = 'a.b.Boat'").count() == 1 and [(r.file_path, r.line) for r in errors.collect()] == [("x.py", 1)]
    assert g.edges.select("project_id", "id").distinct().count() == g.edges.count()


def test_frameworks(spark):
    d = W.framework_annotations(spark)
    rows = spark.createDataFrame([("f", "@Test", "java"), ("f", "BeforeEach ", "java"), ("f", "@Entity", "java"), ("g", "@Nope", "java"), ("h", "@Entity", "java")], "file string, name string, language string")
    assert {(r.name.strip(), r.framework) for r in W.annotated(rows, d).collect()} >= {("@Test", "JUnit"), ("@Nope", None)}
    a = W.by_annotations(rows, d)
    assert {r.file: (r.framework, r.confidence) for r in a.collect()} == {"f": ("JUnit", 40), "h": ("JPA", 20)}
    imports = spark.createDataFrame([("f", "org.junit.jupiter.api.Test", "java"), ("h", "org.springframework.web.X", "java"), ("h", "lombok.Data", "java"), ("n", "@nestjs/common", "typescript")], "file string, module string, language string")
    i = W.by_imports(imports, W.framework_imports(spark))
    assert {r.file: (r.framework, r.confidence) for r in i.collect()} == {"f": ("JUnit", 95), "h": ("Lombok", 95), "n": ("NestJS", 95)}
    assert {r.file: (r.framework, r.confidence) for r in W.combined(a, i).collect()} == {"f": ("JUnit", 100), "h": ("Lombok", 95), "n": ("NestJS", 95)}
    W.register("java", "Later", {"testing": "Test"}, {"later.*": 99})
    try:
        assert W.framework_annotations(spark).where("annotation = 'Test' and language = 'java'").first().framework == "Later"
    finally:
        W.remove("java", "Later")
    assert ("java", "Later") not in W.modules() and W.statistics(spark).where("framework = 'JUnit'").first().annotations == 12


TSX = """import React from 'react';
/** Shows the boats. */
export const App = (p: Props) => <div onClick={() => go(p)}>don't {p.name}</div>;
export function Row() { return <li key="a">{xs.map((x) => <b>{x < 1 ? <></> : load(x)}</b>)}</li>; }
class Panel extends React.Component<P> { render() { return <Box<string> {...p} a='1' b=<i/> />; } }
const id = <T,>(x: T) => x;
"""


def test_markup_in_scripts():
    s = E.extract("p", "ui/App.tsx", TSX)
    assert not s.errors and {(n["type"], n["id"]) for n in s.nodes} == {("module", "ui.App"), ("class", "ui.App.Panel"), ("function", "ui.App.App"), ("function", "ui.App.Row"), ("function", "ui.App.id"), ("method", "ui.App.Panel.render")}
    assert {"ui.App.App_calls_ui.App.go", "ui.App.Row_calls_ui.App.load"} <= {e["id"] for e in s.edges}
    assert next(n for n in s.nodes if n["name"] == "App" and n["type"] == "function")["description"] == "Shows the boats."
    for bad in ("x = <div>hi</span>;", "x = <div>hi;", "x = <div a=>1</div>;", "x = <div>{a b}</div>;", "x = <div>}</div>;", "x = <div", "x = <>a</b>;"):
        assert E.extract("p", "a.jsx", bad).errors, bad
    assert E.extract("p", "a.ts", "const x = <div>hi</div>;").errors and not E.extract("p", "a.ts", "const y = <T>(x);").errors


@pytest.mark.parametrize(
    "text, parts",
    [("a < b, c", ["a < b", "c"]), ("new Map<A, B>(), 'x, y'", ["new Map<A, B>()", "'x, y'"]), ("", []), ("a > b, c < d, e", ["a > b", "c < d", "e"]), ("{a: 1, b: 2}, c,", ["{a: 1, b: 2}", "c"])],
)
def test_arguments_split_at_the_outer_level(text, parts):
    assert E.split_arguments(text) == parts


def test_annotations_by_import(spark):
    java = "package p;\nimport org.axonframework.commandhandling.CommandHandler;\nimport io.micronaut.http.annotation.Controller;\nimport my.Own;\nclass A { @CommandHandler void f() { } @Own void g() { } @Override void h() { } }\n"
    notes = lambda rows: {n["annotations"][0]["name"]: (n["annotations"][0]["framework"], n["annotations"][0]["category"]) for n in rows if n["annotations"]}
    got = notes(E.extract("p", "p/A.java", java).nodes)
    assert got == {"@CommandHandler": ("Axon Framework", "messaging"), "@Own": (None, None), "@Override": ("Java", "core")}
    df = spark.createDataFrame([("p", "p/A.java", java)], "project_id string, source_file string, text string")
    W.register("java", "House", {"own": "Own"})
    try:  # tasks know what's registered on the driver
        rows = [r.asDict(True) for r in E.rows(df).where("kind = 'node'").collect()]
        assert notes(rows)["@Own"] == ("House", "own")
    finally:
        W.remove("java", "House")
    rows = [r.asDict(True) for r in E.rows(df).where("kind = 'node'").collect()]
    assert notes(rows)["@Own"] == (None, None)


def test_import_patterns_equal_brute_force(spark):
    import re

    modules = ["org.springframework.boot.SpringApplication", "org.springframework.web.X", "java.util.List", "javax.ws.rs.GET", "play.mvc.Http", "nothing.here", "lombok.Data", "org.springframeworks.no"]
    df = spark.createDataFrame([(f"f{i}", "java", m) for i, m in enumerate(modules)], "file string, language string, module string")
    got = {r.file: (r.framework, r.confidence) for r in W.by_imports(df, W.framework_imports(spark)).collect()}
    want = {}
    for i, m in enumerate(modules):
        hits = [(-c, k, fw) for k, ((lang, fw), ps) in enumerate(W.IMPORTS.items()) if lang == "java" for p, c in ps.items() if re.search("^" + re.escape(p).replace(r"\*", ".*") + "$", m)]
        if hits:
            want[f"f{i}"] = (min(hits)[2], -min(hits)[0])
    assert got == want
