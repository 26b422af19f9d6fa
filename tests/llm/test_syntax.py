import pytest

from weftgraph.llm import syntax as S

GOOD = {
    "java": [
        "package a.b;\nimport java.util.*;\n@A(x = {1, 2}) public final class F<T extends Comparable<T>> extends G<T> implements H, I.J {\n  private static final Map<String, List<int[]>> m = new HashMap<>();\n  static { m.clear(); }\n  F(int... xs) throws E { this(); }\n  <R> R f(Function<? super T, ? extends R> g) { return g.apply((T) null); }\n}\n",
        'class A { void f() { for (int i = 0, j = 1; i < 3; i++, j--) { if (i > 1 && !(j < 2)) continue; else break; } for (var x : xs) { x++; } do { a[0] >>>= 2; } while (true); String s = """\n  text "quoted" {\n  """; char c = \'\\u0041\'; char d = \'{\'; } }',
        "class A { int f(Object o) { return switch (o) { case Integer i -> i; case String s -> { yield s.length(); } default -> throw new X(); }; } Runnable r = () -> {}; Supplier<A> s = A::new; int[][] q = new int[3][], z[] = {{1}, {}}; boolean b = o instanceof String t && t.isEmpty(); int k = (int) -1 + (x) - 1; }",
        "record P(int x, @N String y) implements Q { P { if (x < 0) throw new E(); } static int z = 1; }\nenum E { A(1) { void g() {} }, B; E() {} E(int i) {} }\n@interface N { int v() default 1; String[] w() default {}; }\nsealed interface S permits T {}\nnon-sealed class T implements S {}\n",
        "class A { void f() { label: while (x) { switch (y) { case 1: case 2: a(); break; default: b(); } } try (var r = open(); s) { } catch (A | B e) { } finally { } synchronized (this) { } assert a > b : \"m\"; new Foo<>() { int z; }.run(); foo.<String>bar(); List<String>[] l; a = b ? (x) -> x : c; } }",
        "",
        "  \n",
    ],
    "python": ["def f(a, /, b, *, c=1, **k):\n    match a:\n        case {'x': [1, *_]}:\n            return f'{a!r:>{b}}'\n    return lambda: (yield)\n", "x = '''a\n=======\n'''\n", "async def g():\n    async with a as b, c:\n        return [x async for x in y if x]\n"],
    "javascript": [
        "#!/usr/bin/env node\nconst re = /[/\\]]+/g, d = a / b / c;\nconst t = `a ${x ? `b ${y}` : '}'} c`;\nexport default class extends B { static #p = 1; get x() { return this.#p } static { init(); } async *gen() { yield* other(); } [k]() {} 'q'() {} }\n",
        "!function(c){c.a=1}({});var a=!0,b=function(p){for(var e=0;e<p.length;e++)p[e]^=70;return p};if(h.s)throw Error('x');md&&jw(md,83),wm=void 0\n",
        "a = b\n++c\nconst f = async ({a, b: [c = 1, ...d]}, ...e) => ({...a, get x() { return 1 }, async y() {}, [z]: 2, w})\nlabel: for (const [k, v] of Object.entries(o)) { if (k in o) continue label; else break label }\n",
        "import d, * as ns from 'm'; import {a as b, default as c} from \"n\"; export * from 'o'; export {b as 'str'}; const x = await import('p'); import.meta.url; new.target;\n".replace("new.target;", ""),
        "x ??= y?.z?.[0]?.(1) ?? -1; for await (const q of s) {} do x++; while (x < 3) y(); switch (a) { case 1: { break } default: }\nif (a) /re/.test(b); else c\nvar let_ = 1; try { } catch { }\n",
        "label => label; async x => x; (function () { return })(); delete a.b, typeof c, void 0;\n",
    ],
    "typescript": [
        "import type { A } from './a';\nexport abstract class C<T extends object = {}> extends D<T> implements E<T>, F {\n  private readonly x?: Map<string, number[]> = new Map<string, number[]>();\n  declare y: string; static z!: number;\n  constructor(private a: string, public readonly b = 1) { super(); }\n  abstract f(): void;\n  get g(): string { return this.x!.size as any as string }\n  @Dec({ a: 1 }) async m<K extends keyof T>(this: C<T>, k: K, ...r: unknown[]): Promise<T[K] | undefined> { return undefined; }\n  [key: string]: any;\n}\n",
        "type U = | 'a' | { readonly [K in keyof T as `x${K}`]?: T[K] extends infer R ? R : never } & (new (...a: any[]) => void);\ninterface I extends J<K> { (x: number): string; new (x: number): I; readonly p?: () => void; m?<T>(a: T): asserts a is string; [i: number]: string }\nenum E { A = 1, B = 'x', C }\ndeclare module 'm' { export const v: unique symbol; }\nnamespace N.M { export let a: typeof import('x') }\n",
        "function f(a: string): a is 'x'; function f(a: any): boolean { return <any>a satisfies unknown; }\nconst g = async <T,>(x: T): Promise<[a: T, b?: number, ...c: string[]]> => { return null as any };\nlet h = a < b && c > d, i = f<number>(1), j = x as const; for (const k of <any[]>q) {}\nexport = f;\n",
        "const a = cond ? (b) : (c); const d = cond ? (x: number): number => x : null; abstract class Q { protected constructor(); } export default interface Z {}\n",
    ],
}
BAD = {
    "java": ["class A {", "class A { } }", "class A { int x = 1 }", 'class A { String s = "abc; }', "class A { /* x }", "class A {\n<<<<<<< HEAD\n}\n", "const x = 1;", "def f():\n    pass\n", "class A { void f() { ${t} h = new (); } }", "class A { void f() { 5; } }", "class A { void f() { int = 3; } }", "public class { }", "class A { void f() { if (a { } } }", "class A { void f() { else { } } }"],
    "python": ["def f(:\n  pass", "def f()\n    pass\n", "x = 'abc\n", "print 'x'\n", "def f():\nreturn 1\n", "if x:\n    a\n  b\n", "{{ v }} + }\n", "<<<<<<< HEAD\nx = 1\n"],
    "javascript": ["function f() {", "const x = `a ${b`;", "let x: number = 1;", "interface A { }", "if (x {}", "const x = {{ v }};", "a b", "return 1", "x = 'a", "diff --git a/x b/y\n", "else {}", "class A { private x = 1; }"],
    "typescript": ["class A { public class B {} }", "def f():\n  return 1\n", "package a.b;\nclass A {}", "let x: = 1;", "function f(a: string { }", "interface A { x: string", "public final class A { private int b_; }"],
}


@pytest.mark.parametrize("language", GOOD)
def test_valid_files_are_accepted(language):
    for text in GOOD[language]:
        assert S.check(text, language) is None, text


@pytest.mark.parametrize("language", BAD)
def test_broken_files_are_rejected(language):
    for text in BAD[language]:
        assert S.check(text, language) is not None, text


def test_truncating_a_valid_file_breaks_it():
    text = GOOD["typescript"][0]
    inner = [i for i in range(text.index("{", text.index("class")) + 1, len(text) - 3)]
    assert sum(S.check(text[:i], "typescript") is None for i in inner) == 0


def test_kinds_and_lines():
    assert S.check("class A {\n  int x;\n", "java") == ("premature end", 3)
    assert S.check("a\n<<<<<<< HEAD\n(\n", "javascript")[0] == "merge conflict"
    assert S.check("x = '''\n=======\n'''\n", "python") is None
    assert S.check("(" * 50_000 + ")" * 50_000, "javascript") is not None


def test_rows(spark):
    rows = [(1, "p", "a/A.java", "class A {"), (1, "p", "a/A.java", "class A {"), (2, "p", "B.PY", "x = 1\n"), (3, None, None, "class"), (4, "p", "c.js", None), (5, "q", "d.ts", ""), (6, "q", "e.txt", "((("), (7, "q", "f.ts", "let a = '" + "x" * 2_000_000 + "';")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "file_id int, project_id string, source_file string, text string, valid string")
    v = S.verdicts(df, keep=("project_id",))
    assert {r.file_id for r in v.where("not valid").collect()} == {1}
    assert {r.file_id: r.language for r in v.collect()}[2] == "python"
    got = {(r.project_id, r.language): (r.files, r.invalid, r.rate) for r in S.rates(v, ["project_id", "language"]).collect()}
    assert got["p", "java"] == (1, 1, 1.0) and got["q", "typescript"] == (2, 0, 0.0)
    assert S.verdicts(df.limit(0)).count() == 0


def test_deep_nesting_is_valid_where_the_language_allows_it():
    import sys

    sys.setrecursionlimit(S.DEPTH)
    assert S.check("x = " + "[" * 3000 + "]" * 3000, "javascript") is None
    assert S.check("class A { int x = " + "(" * 3000 + "1" + ")" * 3000 + "; }", "java") is None
    assert S.check("x = " + "-" * 50_000 + "1", "python") == ("nesting", 1)


def test_markup(spark):
    rows = [(1, "a.tsx", "const A = () => <p>don't {x}</p>;"), (2, "a.jsx", "const A = <p>{x</p>;"), (3, "b.jsx", "f(<><b/></>)"), (4, "a.js", "const A = <p>x</p>;"), (5, "c.tsx", "let a = <p>x</q>;")]
    got = {r.file_id: (r.language, r.valid) for r in S.verdicts(spark.createDataFrame(rows, "file_id long, source_file string, text string")).collect()}
    assert got == {1: ("typescript", True), 2: ("javascript", False), 3: ("javascript", True), 4: ("javascript", False), 5: ("typescript", False)}
