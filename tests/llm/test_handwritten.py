from weftgraph.llm import handwritten as H

BODY = "def step_{i}(boat, tide):\n    if tide > {i}:\n        return boat.wait({i})\n    log.info('boat {i} left {w}')\n    return boat.go(tide, '{w}')\n\n"
WORDS = "amber birch cedar dune elm fern grove heath isle jade kelp lark moss nest oak pine quail reed sage thorn".split()


def own(i):
    return "import logging\nlog = logging.getLogger(__name__)\n\n" + "".join(BODY.format(i=i * 7 + j, w=WORDS[(i * 3 + j) % 20]) for j in range(4 + i % 3))


def files():
    rows, kind = [], {}
    for i in range(120):
        rows.append((i, f"p{i % 12}", f"src/{WORDS[i % 20]}/part_{i}.py", own(i)))
        kind[i] = True
    lib = own(1001)
    for k in range(8):  # one library in several projects, slightly changed
        rows.append((1000 + k, f"p{k}", f"lib{k}/thing.py", lib.replace("boat.wait", f"boat.wait{k}", 1)))
        kind[1000 + k] = False
    for k in range(20):
        rows.append((2000 + k, f"p{k % 12}", f"web/app{k}.js", "/*! v */" + "".join(f"var a{j}=function(b){{return b[{k + j}]^{j}}};" for j in range(60))))
        rows.append((3000 + k, f"p{k % 12}", f"data/t{k}.py", "ROWS = [\n" + "".join(f"    ({k}, {j}, '{WORDS[(k + j) % 20]}'),\n" for j in range(80)) + "]\n"))
        rows.append((4000 + k, f"p{k % 12}", f"gen/G{k}.java", ("// Code generated by tool. DO NOT EDIT.\n" if k % 2 else "") + f"class G{k} {{\n" + "".join(f"    int f{j}_;\n    int getF{j}() {{ return f{j}_; }}\n" for j in range(25 + k)) + "}\n"))
        kind |= {2000 + k: False, 3000 + k: False, 4000 + k: False}
    rows += [(9000, "p1", "src/empty.py", ""), (9001, None, None, None), (9002, "p2", "gen/vendor/hand.py", "# Writes the 'Code generated' banner into stubs.\n" + own(5077))]
    kind |= {9000: True, 9001: True, 9002: True}
    return rows, kind


def test_files(spark):
    rows, kind = files()
    df = spark.createDataFrame([(*r, 0.0) for r in rows + rows[:5]], "file_id long, project_id string, source_file string, text string, score double")
    projects = spark.createDataFrame([(f"p{i}", ["dist", "gen/**"]) for i in range(12)] + [("p3", None), (None, None)], "project_id string, exclude_paths array<string>")
    out, figures = H.classify(df, projects)
    got = {r.file_id: r.handwritten for r in out.collect()}
    assert len(got) == len(kind)
    wrong = {i for i in kind if got[i] != kind[i]}
    assert len(wrong) <= 2 and not wrong & {9000, 9001, 9002}, wrong
    assert figures["accuracy"] > 0.9


def test_empty(spark):
    df = spark.createDataFrame([], "file_id long, project_id string, source_file string, text string")
    out, _ = H.classify(df, spark.createDataFrame([], "project_id string, exclude_paths array<string>"))
    assert out.count() == 0


def test_exclude_patterns():
    assert H.excluded_by("a/dist/b.js", ["dist"]) and H.excluded_by("x/y.min.js", ["**/*.min.js"]) and H.excluded_by("gen/a/b.ts", ["gen/**"])
    assert not H.excluded_by("a/distant/b.js", ["dist"]) and not H.excluded_by("dist", ["dist"]) and not H.excluded_by(None, ["x"]) and not H.excluded_by("a/b", None)


def test_notice_is_masked():
    a, b = H.features("x/y.py", "# Code generated by me. DO NOT EDIT.\n\nx = 1\n", False), H.features("x/y.py", "x = 1\n", False)
    assert (a[0] == b[0]).all()
