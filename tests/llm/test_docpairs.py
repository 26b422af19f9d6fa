import pytest

from weftgraph.llm import docpairs as P
from weftgraph.llm import plans

JAVA = """/** Keeps an eye on boats and their cargo. */
public class A extends B {
    /** Opens the harbour gate once the tide has turned twice. */
    @Override
    @Names({"(", "x"})
    public int open(int gate) { return 1; }

    /** @param x the x */
    int tagged(int x) { return x; }

    int plain() { return 1; } // Counts every boat that passes before noon.
    int next() { return 2; }

    // Moves every parcel to the cellar
    // before the rain arrives.
    void move() { }
    /** {@inheritDoc} */
    int inherit() { return 3; }
    /** Abstract things need no body but words. */
    abstract int none();
    /** Separated by an empty line from what follows here. */

    int apart() { return 1; }
    /** void fake() { } is in a comment, strings lie too. */
    String s = "int faked() { return 0; }";
}
"""
PY = '''class A(B):
    @cached
    # Sorts fruit, bread and cheese by weight and colour.
    def sort(self):
        return 1

    def open_gate(self):
        """Open gate.

        Args:
            x: a very long description of nothing at all
        """

    def swim(self, far):
        r"""Crosses the river unless the bridge is open.
        :param far: how far
        """
        def inner():
            """Waits for three lanterns before going home."""
            return """def fake(): pass"""

    # x = 1
    # return x
    def dead(self): ...
'''
TS = """/** Weighs all parcels again whenever the scale was moved. */
export const weigh = async (a: number): Promise<void> => { go(a); };
/* Tells the captain about leaks below deck. */
export default function tell() { return 1; }
export class K {
  /** Draws the map with north pointing to the left. */
  @Dec() draw(a?: string): void { }
  // ---------------
  x = () => { };
  /** Overloads carry words yet lack a body here. */
  over(a: string): void;
  over(a: any): void { }
}
const o = { /** Rings the brass bell for every guest that leaves. */ ring() { return 1; } };
"""


def found(text, language):
    return {(d.name, d.line) for d in P.functions_of(text, language)[0] if d.body and not P.trivial(d.doc, d.name)}


def test_java():
    assert found(JAVA, "java") == {("open", 6), ("move", 16)}
    names = {d.name for d in P.functions_of(JAVA, "java")[0]}
    assert "fake" not in names and "faked" not in names


def test_python():
    assert found(PY, "python") == {("sort", 4), ("swim", 14), ("inner", 18)}


def test_typescript():
    assert found(TS, "typescript") == {("weigh", 2), ("tell", 4), ("draw", 7), ("ring", 14)}


@pytest.mark.parametrize("doc", ["/** TODO: explain */", "// ------", "/** See above. */", "/* Gets the open gates. */", "// gate.open(1);\n// return total;", "/** @return the number of boats in the harbour today */", "", "/** {@inheritDoc} */", "/** N/A */", "// Opening a gate", None])
def test_trivial(doc):
    assert P.trivial(doc, "openGate")


@pytest.mark.parametrize("doc", ["/** Lets boats pass while water is high. */", "# Lets boats pass while water is high", "Lets boats\npass while water is high.\n\nReturns:\n  x", "/** <p>Lets {@link Boat boats} pass while <b>water</b> is high.\n * @since 1 */"])
def test_telling(doc):
    assert not P.trivial(doc, "openGate")


def test_inheritance_and_rows(spark):
    base = "class B extends C { /** Counts the gulls that sit on deck. */ int inherit() { return 0; } }"
    far = "interface C { /** Lists every sailor who came back late. */ int next(); }"
    loop = "class L extends M { int z() { return 1; } } class M extends L { int z() { return 2; } }"
    rows = [(1, "p", "A.java", JAVA), (1, "p", "A.java", JAVA), (2, "p", "B.java", base), (3, "p", "C.java", far), (4, "q", "L.java", loop), (5, None, "x.py", None), (6, "p", None, "def f(): pass"), (7, "p", "bad.py", "def f(")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "file_id long, project_id string, source_file string, text string, name int")
    got = {(r.file_id, r.name): (r.inherited, r.doc) for r in P.pairs(df).collect()}
    assert got[1, "inherit"] == (True, "Counts the gulls that sit on deck.") and got[1, "next"] == (True, "Lists every sailor who came back late.")
    assert got[1, "open"][0] is False and (1, "plain") not in got and not any(f in (4, 5, 6, 7) for f, _ in got)
    assert {(r.file_id, r.name) for r in P.pairs(df, inherit=False).collect()} == {(1, "open"), (1, "move"), (2, "inherit")}
    assert P.pairs(df.limit(0)).count() == 0


def test_found_runs_the_joins_over_the_hierarchy(spark, monkeypatch, tmp_path):
    java = ["/** Keeps boats. */ class A extends B {\n int open(int g) { return 1; }\n /** Counts every boat that passes before noon. */\n int count() { return 2; }\n}", "class B {\n /** Opens the harbour gate once the tide has turned twice. */\n int open(int g) { return 0; }\n}"]
    files = [(i, "p", f"{'AB'[i]}.java", "java", t, None) for i, t in enumerate(java)]
    spark.createDataFrame(files, "file_id long, project_id string, source_file string, language string, text string, scanned_at timestamp").write.parquet(str(tmp_path / "source_files.parquet"))
    names, write = [], P.written
    monkeypatch.setattr(P, "written", lambda df, name="part": names.append(name) or write(df, name))
    got = {(r.file_id, r.name, r.line) for r in plans.p6_found(spark, str(tmp_path)).collect()}
    assert got == {(0, "count", 4), (1, "open", 3)} and "step" in names


DOC = "/** Counts every boat that passes the {} before noon. */"


def test_bases_by_package_and_import_and_overloads(spark):
    files = {
        "x/Base.java": "package x; public class Base { " + DOC.format("weir") + " int run(int a) { return a; }\n " + DOC.format("quay") + " int run(java.util.Map<String, Integer> a, int b) { return b; } }",
        "y/Base.java": "package y; public class Base { " + DOC.format("lock") + " int run(int a) { return a; } }",
        "z/A.java": "package z; import y.Base; class A extends Base { int run(int b) { return 1; }\n int run(int b, int c) { return 2; } }",
        "x/B.java": "package x; class B extends Base { int run(int b) { return 1; }\n int run(int b, int c) { return 2; } }",
        "z/C.java": "package z; class C extends Base { int run(int b) { return 1; } }",
        "t/b.ts": "export class Base { " + DOC.format("pier") + " run(): void { } }",
        "t/sub/c.ts": "import { Base as Far } from '../b';\nclass C extends Far { run(): void { } }",
        "t/d.ts": "import { Base } from 'elsewhere';\nclass D extends Base { run(): void { } }",
        "src/m/b.py": 'class Base:\n    def run(self):\n        """Counts every boat that passes the dam before noon."""\n',
        "src/m/c.py": "from .b import Base\nclass C(Base):\n    def run(self):\n        return 1\n",
        "src/n/d.py": "import m.b as far\nclass D(far.Base):\n    def run(self):\n        return 1\n",
    }
    df = spark.createDataFrame([(i, "p", path, text) for i, (path, text) in enumerate(files.items())], "file_id long, project_id string, source_file string, text string")
    path = list(files)
    got = sorted((path[r.file_id], r.code.count(","), r.doc.split()[6]) for r in P.pairs(df).where("inherited").collect())
    assert got == [("src/m/c.py", 0, "dam"), ("src/n/d.py", 0, "dam"), ("t/sub/c.ts", 0, "pier"), ("x/B.java", 0, "weir"), ("x/B.java", 1, "quay"), ("z/A.java", 0, "lock")]


def test_a_method_meets_an_ancestor_once(spark):
    n = 14  # 2^14 ways to the top
    faces = ["interface L0 { " + DOC.format("moat") + " int run(); }"] + [f"interface {s}{i} extends L{i - 1}, R{i - 1} {{}}" for i in range(1, n) for s in "LR"]
    text = "\n".join([*faces, "interface R0 extends L0 {}", f"class Z implements L{n - 1}, R{n - 1} {{ int run() {{ return 1; }} }}"])
    df = spark.createDataFrame([(1, "p", "Z.java", text)], "file_id long, project_id string, source_file string, text string")
    rows = P.pairs(df).where("inherited").collect()
    assert len(rows) == 1 and "moat" in rows[0].doc
