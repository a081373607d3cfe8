import itertools

import pytest

from millrace.dsl import context, document, reverse, rows

ROOT = '["root","Column",{"width":160,"height":160},%s]'


def card(*lines, children=None):
    ids = children or [line.split('"')[1] for line in lines if not line.startswith('["/')]
    return "\n".join([ROOT % ("[" + ",".join(f'"{i}"' for i in ids) + "]"), *lines])


TEXT = '["t","Text",{"content":"hi"}]'
BUTTON = '["a","Button",{"label":"Go","design":"capsule","onClick":[{"call":"x"}]}]'
VALID = {
    "text": card(TEXT),
    "designs": card(*(f'["d{i}","Text",{{"content":"x","design":"{d}"}}]' for i, d in enumerate(document.t.DESIGNS["Text"]))),
    "containers": card('["r","Row",{"itemMargin":4},["l","s"]]', '["l","List",{"space":2,"listDirection":"vertical"},[]]', '["s","Stack",{"alignContent":"center"},[]]', children=["r"]),
    "image": card('["i","Image",{"src":"resources/base/media/a.png","design":"source-icon"}]'),
    "divider": card('["d","Divider",{"design":"line"}]'),
    "bar": card('["b","Progress",{"value":3,"total":9,"design":"linear-bar-small","color":"warning"}]'),
    "ring": card('["b","Progress",{"value":{"path":"/n"},"total":9,"design":"ring"}]', '["/n",4]'),
    "checkbox": card('["c","Checkbox",{"label":"x","select":true,"design":"default"}]'),
    "button": card(BUTTON),
    "icon button": card('["a","Button",{"design":"icon-round","onClick":[{"call":"x"}]},["i"]]', '["i","Image",{"src":"resources/base/media/a.png"}]', children=["a"]),
    "bare icon button": card('["a","Button",{"design":"icon-round"}]'),
    "capsule": card('["a","ActionUnit",{"state":"capsule","label":"Go","actionInk":"alert","enabled":{"path":"/on"},"onClick":[{"call":"x"}]}]', '["/on",true]'),
    "round": card('["a","ActionUnit",{"state":"icon-round","icon":"resources/base/media/a.png","onClick":[{"call":"x","args":{"p":{"path":"/u"}}}]}]', '["/u","v"]'),
    "expression": card('["t","Text",{"content":{"expression":"${/a~1b/0} > 1 ? \'x\' : \\"y\\""}}]', '["/a~1b/0",2]'),
    "model": card(TEXT, '["/a/b",1]', '["/a",{"c":2}]', '["/l/2","z"]', '["/",{"a":{"d":null}}]'),
    "definition": card(TEXT, '["m","DataDef",{"path":"/k","value":1}]'.replace('["m"', '["m"'), children=["t"]),
    "gradient": card(TEXT).replace('"height":160', '"height":160,"linearGradient":{"angle":1,"colors":[["alert",0],["#FF000000",1]]}'),
    "empty image": card('["e","Image",{"src":""}]', TEXT),
    "unordered": "\n".join(reversed(card(TEXT, '["r","Row",{},["u"]]', '["u","Text",{"content":"u"}]', children=["t", "r"]).split("\n"))),
}
REPAIRED = {
    "fence": ("```genui\n" + card(TEXT) + "\n```", card(TEXT)),
    "prose": ("Sure!\n" + card(TEXT) + "\nDone.", card(TEXT)),
    "comma": (card('["t","Text",{"content":"hi",},]'), card(TEXT)),
    "tail": (card(TEXT)[:-2], card(TEXT)),
    "closer": (card('["t","Text",{"content":"hi"]}]'), card(TEXT)),
    "children in properties": ('["root","Column",{"width":160,"height":160,"children":["t"]}]\n' + TEXT, card(TEXT)),
    "text": (card('["t","Text",{"text":"hi"}]'), card(TEXT)),
    "value": (card('["t","Text",{"value":"hi"}]'), card(TEXT)),
    "grow": (card('["t","Text",{"content":"hi","flexGrow":1}]'), card('["t","Text",{"content":"hi","layoutWeight":1}]')),
    "full width": (card('["t","Text",{"content":"hi","width":"100%"}]'), card('["t","Text",{"content":"hi","width":"matchParent"}]')),
    "axis": (card('["r","Row",{"justifyContent":"space-between","alignItems":"start"},[]]'), card('["r","Row",{"justifyContent":"spaceBetween","alignItems":"top"},[]]')),
    "space": (card('["r","Row",{"space":3},[]]'), card('["r","Row",{"itemMargin":3},[]]')),
    "list": (card('["l","List",{"itemMargin":3},[]]'), card('["l","List",{"space":3},[]]')),
    "ring": (card('["b","Ring",{"value":1,"total":2,"size":9,"colors":[["alert",0]]}]'), card('["b","Progress",{"value":1,"total":2,"width":9,"height":9,"color":"alert","design":"ring"}]')),
    "handler": (card('["a","Button",{"label":"x","onClick":{"call":"c"}}]'), card('["a","Button",{"label":"x","onClick":[{"call":"c"}]}]')),
    "pair": (card('["a","Button",{"label":"x","onClick":["c",{"args":{"k":1}}]}]'), card('["a","Button",{"label":"x","onClick":[{"call":"c","args":{"k":1}}]}]')),
    "old binding": (card('["t","Text",{"content":{"$(data)":"/n"}}]', '["/n","v"]'), card('["t","Text",{"content":{"path":"/n"}}]', '["/n","v"]')),
}
INVALID = {
    "empty": ("", "empty"), "two fences": ("```\n[1]\n```\n```", "fence"), "open string": ('["a', "rows"), "between": ('["/a",1] x ["/b",2]', "rows"), "mismatch": ('["a"}', "rows"),
    "shape": ("[1]", "shape"), "type": ('["x","Nope",{}]', "header"), "props": ('["x","Text",[]]', "header"), "container": ('["x","Row",{}]', "children"), "leaf": ('["x","Text",{"content":"a"},["k"]]', "children"),
    "twice": ('["x","Row",{},["k","k"]]', "children"), "legacy": ('["x","Text",{"content":"a","action":1}]', "legacy"), "spacing": ('["x","Text",{"content":"a","space":1}]', "spacing"),
    "token before property": ('["x","Text",{"content":"a","fontSize":"Body_L","nope":1}]', "token"), "property": ('["x","Text",{"content":"a","nope":1}]', "property"),
    "number": ('["x","Text",{"content":"a","opacity":true}]', "type"), "edges": ('["x","Text",{"content":"a","margin":{"up":1}}]', "type"), "required": ('["x","Text",{}]', "required"), "label": ('["x","Button",{"label":" "}]', "label"),
    "skin": ('["x","ActionUnit",{"state":"capsule","label":"a","onClick":[{"call":"c"}],"width":1}]', "skin"), "state": ('["x","ActionUnit",{"state":"z"}]', "state"), "no event": ('["x","ActionUnit",{"state":"capsule","label":"a"}]', "event"),
    "image": ('["x","Image",{"src":"http://a"}]', "source"), "total": ('["x","Progress",{"value":1}]', "value"), "events": ('["x","Text",{"content":"a","onClick":[]}]', "event"), "template": ('["x","Text",{"content":"{{ a }}"}]', "source"),
    "path": ('["x","Text",{"content":{"path":"a"}}]', "binding"), "escape": ('["x","Text",{"content":{"path":"/a~"}}]', "pointer"), "expression": ('["x","Text",{"content":{"expression":"${/a}"}}]', "expression"),
    "button child": (card('["a","Button",{"label":"x"},["t"]]', TEXT, children=["a"]), "icon"), "no root": (TEXT, "root"), "missing": (ROOT % '["x"]', "missing"), "duplicate": (card(TEXT, TEXT, children=["t"]), "duplicate"),
    "two parents": (card('["r","Row",{},["t"]]', TEXT, children=["r", "t"]), "parent"), "size": ('["root","Column",{"width":1,"height":1},[]]', "size"), "design": (card('["t","Text",{"content":"a","design":"huge"}]'), "design"),
    "conflict": (card(TEXT, '["/a",1]', '["/a",2]'), "model"), "scalar": (card(TEXT, '["/a",1]', '["/a/b",2]'), "model"), "unbound": (card('["t","Text",{"content":{"path":"/a"}}]'), "unbound"),
}


@pytest.mark.parametrize("name", VALID)
def test_round_trip(name):
    made = document.to_document(VALID[name], "2x2")
    back, again, report = reverse.verify(made, "2x2")
    assert report["roundtrip"] == "pass" and again == made
    assert reverse.to_card(again, "2x2") == back and reverse.exit_code(report) == 0


@pytest.mark.parametrize("name", REPAIRED)
def test_repairs(name):
    given, want = REPAIRED[name]
    assert document.expand_tokens(given) == document.expand_tokens(want)


@pytest.mark.parametrize("name", INVALID)
def test_errors(name):
    text, kind = INVALID[name]
    with pytest.raises(rows.CardError) as e:
        document.to_document(text, "2x2")
    assert e.value.kind == kind


def test_orphans_are_dropped_and_told():
    read = rows.read_card(card(TEXT, '["o","Text",{"content":"x"}]', children=["t"]))
    assert [c.id for c in read.components] == ["root", "t"] and read.dropped == ["o"]


def test_first_design_wins_and_aliases():
    back = reverse.to_card(document.to_document(card('["t","Text",{"content":"a","design":"meta-text"}]'), "2x2"))
    assert '"design":"body-s"' in back


def test_model_merges():
    model = document.data_model(rows.read_card(VALID["model"]))
    assert model == {"a": {"b": 1, "c": 2, "d": None}, "l": [None, None, "z"]}
    assert document.data_model(rows.read_card(VALID["text"])) == {"data": {}}


def test_sizes():
    wide = card(TEXT).replace('"width":160', '"width":320')
    made = document.to_document(wide, "4x2")
    with pytest.raises(reverse.DocumentError, match="size"):
        reverse.to_card(made)
    assert reverse.size_from_specs(None, {"size": "2x4"}, {"cardSpec": {"suggestSize": "2x4"}}) == "2x4"
    with pytest.raises(reverse.DocumentError):
        reverse.size_from_specs(None, {"size": "2x4"}, {"size": "2x2"})


def test_document_errors():
    made = document.to_document(card(TEXT), "2x2")
    surface, update, model = made.split("\n")
    for bad in ("", surface, "\n".join([surface, surface, model]), made.replace("v0.9", "v1", 1), made.replace('"path":"/"', '"path":"/x"'), made.replace('"content"', '"contents"'), "```\n" + made):
        with pytest.raises(reverse.DocumentError):
            reverse.read_document(bad)
    assert reverse.read_document("```genui\n" + made + "\n```").order == ["root", "t"]


def test_differences():
    assert reverse.differences({"a": 1, "b": [1, True]}, {"a": 1.0, "b": [1]}) == [{"path": "$.b[1]", "kind": "removed", "source": True}]
    assert len(reverse.differences(list(range(500)), [])) == 200


TASK = {"dataModelSchema": {"data": {"n": {"type": "integer"}, "l": [{"s": {"type": "string"}}]}}, "assetCandidates": [{"src": "resources/base/media/a.png"}], "eventCandidates": [{"action": {"call": "c", "args": {"uri": "u", "k": {"x": 1}}}}]}
SPEC = {"dataBindings": [{"writeResultTo": "/data/n"}, {"writeResultTo": "/data/l"}]}


def bound(path, value, more=""):
    return card(f'["t","Text",{{"content":{{"path":"{path}"}}}}]', *([more] if more else []), f'["{path}",{value}]')


def test_context():
    assert context.check_context(bound("/data/n", 3), TASK, SPEC) == ["/data/l: declared data is not used"]
    for text, kind in ((bound("/data/z", 3), "schema"), (bound("/data/n", '"3"'), "schema"), (card(BUTTON), "event"), (card('["i","Image",{"src":"resources/base/media/b.png"}]'), "asset")):
        with pytest.raises(rows.CardError) as e:
            context.check_context(text, TASK, SPEC)
        assert e.value.kind == kind
    with pytest.raises(rows.CardError) as e:
        context.check_context(bound("/data/n", 3), TASK, {})
    assert e.value.kind == "root"


def test_mending():
    moved = context.mend(bound("/s", '"x"'), {**TASK, "dataModelSchema": {"r": {"s": {"type": "string"}}}}, {"dataBindings": [{"writeResultTo": "/r"}]})
    assert '{"path":"/r/s"}' in moved
    inlined = context.mend(bound("/s", 5), {"dataModelSchema": {}}, {})
    assert '"content":"5"' in inlined and "/s" not in inlined
    event = context.mend(card(BUTTON.replace('"call":"x"', '"call":"c","args":{"k":{"x":1}}')), TASK, SPEC)
    assert '"uri":"u"' in event
    assert context.mend(bound("/data/n", 3), TASK, SPEC) == bound("/data/n", 3)


def test_schema_paths():
    assert dict(context.flatten_schema(TASK["dataModelSchema"]))["/data/l/0/s"] == "string"
    assert context.schema_node({"a": {"type": "array", "items": {"type": "object", "properties": {"b": 1}}}}, "/a/3/b") == 1


def test_expression_tokens():
    good = ["${/a} + 1", "${/a} == null && !${/b}", "(${/a} % 2) ? 'x\\'y' : .5", "${/a} + + )"]
    bad = ["${/a}", "1 + 1", " ${/a}+1", "${a} + 1", "${/a + 1", "${/a} + 'x", "${/a} + nullx", "${/a} @ 1"]
    assert all(rows.expression_paths({"expression": x}) for x in good)
    for x in bad:
        with pytest.raises(rows.CardError):
            rows.expression_paths({"expression": x})


def test_every_pair_of_parts_round_trips():
    parts = [v.split("\n", 1)[1] for k, v in VALID.items() if k in ("text", "image", "divider", "bar", "checkbox", "capsule")]
    for a, b in itertools.permutations(parts, 2):
        made = document.to_document(card(*a.split("\n"), *b.split("\n")), "2x2")
        assert reverse.verify(made, "2x2")[2]["roundtrip"] == "pass"


def test_cards_of_one_file_are_worked_on_by_many_tasks(spark, tmp_path):
    from millrace.plans import card_queries
    from millrace.plans.registry import Tables

    rows = [(k, k % 50, f"name {k}") for k in range(400)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_name string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    made = card_queries._cards(Tables(spark, str(tmp_path)))
    sizes = [n for n in made.rdd.mapPartitions(lambda rs: [sum(1 for _ in rs)]).collect() if n]
    assert len(sizes) >= 8 and max(sizes) < 100


def test_rows_are_read_alike_alone_and_again():
    text = '[ "root", "Column", {"width":160,"height":160}, ["t"]]\n["t","Text",{"content":"[x]",}]}'
    assert rows.json_rows(text) == ([["root", "Column", {"width": 160, "height": 160}, ["t"]], ["t", "Text", {"content": "[x]"}]], True)
    first, again = rows.read_card(text), rows.read_card(text)
    assert first == again and first.components[0] is again.components[0]
    document.expand(first.components[0]).props["width"] = 1
    assert rows.read_card(text) == first and first.components[0].props["width"] == 160
    with pytest.raises(rows.CardError, match="row 2 "):
        rows.read_card('["root","Column",{},["t"]]["t",1]')
    with pytest.raises(rows.CardError, match="text between rows"):
        rows.read_card('["root" "Column"] x ["t",1]')


def test_a_nan_differs_from_itself():
    nan = float("nan")
    assert len(reverse.differences({"a": nan}, {"a": nan})) == 1 and reverse.differences({"a": 1}, {"a": True}) == []


def test_declared_paths_are_never_broadcast(spark, tmp_path):
    from millrace.dsl import columns as C

    text = card('["t","Text",{"content":{"path":"/l/2/s"}}]', '["u","Text",{"content":{"path":"/n"}}]', '["/l/2/s","x"]', '["/n",1]')
    schemas = [("1", '{"l":[{"s":{"type":"string"}}],"n":{"type":"integer"}}'), ("2", '{"l":[{"s":{"type":"string"}}]}'), ("2", '{"l":[]}'), ("3", None), ("5", '{"n":{"type":"integer"}}')]
    spark.createDataFrame([(k, text) for k in "1234"] + [(None, text)], "case string, card string").write.parquet(str(tmp_path / "cards"))
    spark.createDataFrame(schemas, "case string, schema string").write.parquet(str(tmp_path / "tasks"))
    cards, tasks = (spark.read.parquet(str(tmp_path / x)) for x in ("cards", "tasks"))
    made = C.undeclared_bindings(C.card_rows(cards, "case", "card"), C.schema_paths(tasks, "case", "schema"))
    want = [("2", "u", "/n")] + [(k, *x) for k in ("3", "4", None) for x in (("t", "/l/2/s"), ("u", "/n"))]
    assert sorted(made.select("case", "id", "path").collect(), key=str) == sorted(want, key=str)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
