"""Card text to checked rows: finding and mending JSON rows, older spellings, property rules, tree order.

Rules sit in tables: a property's value rule is looked up by its name, an
alias by its component. The first rule that fails gives the error.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from functools import cache, lru_cache
from typing import Any

from ..functions.json import PointerError, pointer_parts
from . import tables as t


class CardError(ValueError):
    """A card that breaks a rule; ``kind`` names the rule's group."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass(frozen=True)
class Component:
    id: str
    type: str
    props: dict[str, Any]
    children: tuple[str, ...] = ()

    def row(self) -> list[Any]:
        tail = [list(self.children)] if self.type in t.CONTAINERS or self.children else []
        return [self.id, self.type, self.props, *tail]


@dataclass(frozen=True)
class Data:
    path: str
    value: Any

    def row(self) -> list[Any]:
        return [self.path, self.value]


@dataclass
class Card:
    """The rows of a card in canonical order, and what reading it took."""

    components: list[Component]
    data: list[Data]
    repaired: bool = False
    dropped: list[str] = field(default_factory=list)


#: Compact JSON with sorted keys.
compact = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode


def dump_rows(rows: list[Any]) -> str:
    return "\n".join(map(compact, rows))


def fresh(value: Any) -> Any:
    """A JSON value with objects and lists of its own."""
    if isinstance(value, dict):
        return {k: fresh(v) for k, v in value.items()}
    return [fresh(v) for v in value] if isinstance(value, list) else value


# --- text to JSON rows ----------------------------------------------------------------------------------------


def strip_fence(text: str) -> str:
    """The body of the first fence in a known language, which may lack its end; all text if there is none. A second fence is an error."""
    text = text.lstrip("﻿").strip()
    lines = text.splitlines()
    start = next((i for i, x in enumerate(lines) if x.strip().lower() in t.FENCES), None)
    if start is None:
        return text
    rest = lines[start + 1 :]
    end = next((i for i, x in enumerate(rest) if x.strip() == "```"), len(rest))
    body = "\n".join(rest[:end]).strip()
    if "```" in body or any(x.strip().startswith("```") for x in rest[end + 1 :]):
        raise CardError("fence", "more than one fence")
    return body


_MARKS = re.compile(r'"(?:[^"\\]|\\.)*("?)|[\[\]{}]', re.S)
_BETWEEN = re.compile(r"[^\s\]}]")
_decode = json.JSONDecoder().raw_decode
_NEXT = re.compile(r"\s*(\S?)")
_PARTNER = {"[": "]", "{": "}"}


def _row_end(body: str, start: int) -> tuple[str, int, bool]:
    """The text of the row that starts here, closed where it is left open, its end, and whether that took mending."""
    open_, parts, done, at, mended = ["]"], [], start, start + 1, False
    while found := _MARKS.search(body, at):
        mark, at = found[0][0], found.end()
        if mark == '"':
            if not found[1]:
                raise CardError("rows", "a string does not end")
        elif mark in _PARTNER:
            open_.append(_PARTNER[mark])
        elif mark == open_[-1]:
            open_.pop()
            if not open_:
                return "".join([*parts, body[done:at]]), at, mended
        elif _NEXT.match(body, at)[1] == open_[-1]:
            parts.append(body[done : found.start()])
            done, mended = at, True
        else:
            raise CardError("rows", "closers do not match")
    return "".join([*parts, body[done:], *reversed(open_)]), len(body), True


def row_texts(body: str) -> tuple[list[str], bool]:
    """The texts of the top-level arrays, and whether mending was needed; a row that is sound JSON is not looked at mark by mark."""
    rows, mended, last, start = [], False, None, body.find("[")
    while start >= 0:
        if last is not None and _BETWEEN.search(body, last, start):
            raise CardError("rows", "text between rows")
        try:
            last = _decode(body, start)[1]
            row = body[start:last]
        except (ValueError, RecursionError):
            row, last, more = _row_end(body, start)
            clean = drop_commas(row)
            mended |= more or clean != row
            row = clean
        rows.append(row)
        start = body.find("[", last)
    if not rows:
        raise CardError("empty", "no rows")
    return rows, mended


def row_value(row: str, number: int) -> Any:
    try:
        return json.loads(row)
    except ValueError as e:
        raise CardError("json", f"row {number} is not JSON: {e}") from e


def json_rows(body: str) -> tuple[list[list[Any]], bool]:
    """The top-level arrays of a text, and whether mending was needed.

    Text before the first and after the last row is ignored; between rows only
    white space and closers may stand. A wrong closer right before the right
    one is dropped, and what the end leaves open is closed, but not a string.
    """
    rows, mended = row_texts(body)
    return [row_value(r, n) for n, r in enumerate(rows, 1)], mended


_COMMA = re.compile(r'("(?:[^"\\]|\\.)*")|,(?=\s*[\]}])', re.S)


def drop_commas(row: str) -> str:
    """Without commas before a closer, outside strings."""
    return _COMMA.sub(lambda m: m[1] or "", row)


# --- bindings and expressions ---------------------------------------------------------------------------------


def is_path(value: Any) -> bool:
    return isinstance(value, dict) and set(value) == {"path"}


def is_bound(value: Any) -> bool:
    return is_path(value) or isinstance(value, dict) and set(value) == {"expression"}


def _pointer(path: Any, where: str) -> None:
    if not isinstance(path, str) or not path.startswith("/"):
        raise CardError("binding", f"{where}: a path binding holds a pointer")
    try:
        pointer_parts(path)
    except PointerError as e:
        raise CardError("pointer", f"{where}: {e}") from e


_TOKEN = re.compile(
    r"\s+|\$\{(?P<path>[^}]*)(?P<end>\}?)|(?P<string>'(?:[^'\\]|\\.)*(?:'|(?P<open1>$))|\"(?:[^\"\\]|\\.)*(?:\"|(?P<open2>$)))"
    r"|\d+(?:\.\d*)?|\.\d+|(?:true|false|null)(?![\w])|" + "|".join(map(re.escape, t.OPERATORS)), re.S
)


def expression_paths(binding: Any, where: str = "expression") -> list[str]:
    """The paths of an expression binding, left to right. The check is lexical: tokens, not grammar."""
    text = binding.get("expression")
    if set(binding) != {"expression"} or not isinstance(text, str) or not text.strip():
        raise CardError("expression", f"{where}: an expression binding holds one text")
    if text != text.strip() or any(x in text for x in ("{{", "}}", "$item", "$__dataModel")):
        raise CardError("expression", f"{where}: forbidden text in an expression")
    paths, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None or m["open1"] is not None or m["open2"] is not None:
            raise CardError("expression", f"{where}: no token at {at}")
        if m["path"] is not None:
            if not m["end"] or not m["path"].startswith("/") or "{" in m["path"]:
                raise CardError("expression", f"{where}: bad path")
            _pointer(m["path"], where)
            paths.append(m["path"])
        at = m.end()
    if not paths or text == "${" + paths[0] + "}":
        raise CardError("expression", f"{where}: an expression is more than one path and has one")
    return paths


def check_source(value: Any, where: str) -> None:
    """No template text, no function calls, well-formed bindings, at any depth."""
    if isinstance(value, str):
        if any(x in value for x in t.FORBIDDEN_FRAGMENTS):
            raise CardError("source", f"{where}: template text")
    elif isinstance(value, list):
        for x in value:
            check_source(x, where)
    elif isinstance(value, dict):
        if "functionCall" in value:
            raise CardError("legacy", f"{where}: functionCall")
        if "path" in value:
            if set(value) != {"path"}:
                raise CardError("binding", f"{where}: a path binding holds nothing else")
            _pointer(value["path"], where)
        elif "expression" in value:
            expression_paths(value, where)
        else:
            for x in value.values():
                check_source(x, where)


def binding_paths(value: Any) -> list[str]:
    """Paths bound anywhere in a value, in order, with repeats."""
    if is_path(value):
        return [value["path"]]
    if is_bound(value):
        return expression_paths(value)
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [p for x in inner for p in binding_paths(x)]


def map_leaves(value: Any, change) -> Any:
    """``change`` applied to each node from the top; where it returns a new one, that stands."""
    new = change(value)
    if new is not value:
        return new
    if isinstance(value, dict):
        return {k: map_leaves(v, change) for k, v in value.items()}
    return [map_leaves(v, change) for v in value] if isinstance(value, list) else value


# --- older spellings ------------------------------------------------------------------------------------------


def _old_binding(value: Any) -> Any:
    if isinstance(value, dict) and len(value) == 1:
        ((key, path),) = value.items()
        if isinstance(path, str) and path.startswith("/") and "data" in re.sub(r"[\\()]", "", key).lower():
            return {"path": path}
    return value


def _handlers(value: Any) -> Any:
    if isinstance(value, dict):
        return [value]
    if isinstance(value, list) and len(value) == 2 and isinstance(value[0], str) and isinstance(value[1], dict):
        args = value[1]
        return [{"call": value[0], "args": args["args"] if set(args) == {"args"} and isinstance(args["args"], dict) else args}]
    return value


def _rename(props: dict, old: str, *new: str) -> None:
    """Move a value to names that are not taken yet."""
    if old in props:
        value = props.pop(old)
        for name in new:
            props.setdefault(name, value)


def _alias(props: dict, name: str, spellings: dict) -> None:
    if isinstance(props.get(name), str):
        props[name] = spellings.get(props[name], props[name])


def modernise(id_: Any, type_: Any, props: Any) -> tuple[Any, Any]:
    """Type and properties with older spellings replaced; a newer spelling that is there stays."""
    if not isinstance(props, dict):
        return type_, props
    props = map_leaves(props, _old_binding)
    props = dict(props)
    if id_ == "root":
        props.pop("size", None)
    _rename(props, "flexGrow", "layoutWeight")
    for name in ("width", "height"):
        _alias(props, name, {"100%": "matchParent", "stretch": "matchParent"})
    _alias(props, "justifyContent", t.JUSTIFY_ALIASES)
    _alias(props, "alignItems", t.ALIGN_ALIASES.get(type_, {}) if isinstance(type_, str) else {})
    if type_ in ("Row", "Column"):
        _rename(props, "space", "itemMargin")
    elif type_ == "List":
        _rename(props, "itemMargin", "space")
    elif type_ == "Text" and "content" not in props:
        _rename(props, "value" if "value" in props else "text", "content")
    elif type_ in ("Progress", "Ring"):
        if type_ == "Ring" and "design" not in props and "type" not in props:
            props["design"] = "ring"
        if props.get("size") is None:
            props.pop("size", None)
        _rename(props, "size", "width", "height")
        stops = props.pop("colors", None)
        first = stops[0] if isinstance(stops, list) and stops else None
        first = first.get("color") if isinstance(first, dict) else first[0] if isinstance(first, list) and first else None
        if isinstance(first, str):
            props.setdefault("color", first)
        type_ = "Progress"
    if "onClick" in props:
        props["onClick"] = _handlers(props["onClick"])
    return type_, props


# --- property rules -------------------------------------------------------------------------------------------


def is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _is_text(value: Any) -> bool:
    return isinstance(value, str) and value != ""


def _is_spacing(value: Any) -> bool:
    return is_number(value) or isinstance(value, dict) and set(value) <= t.EDGES and all(map(is_number, value.values()))


VALUE_RULES = (
    {n: is_number for n in (*t.NUMBERS, "itemMargin", "space")}
    | {n: lambda v: is_number(v) or is_bound(v) for n in t.BOUND_NUMBERS}
    | {n: lambda v: isinstance(v, bool) for n in t.BOOLEANS}
    | {n: _is_text for n in t.STRINGS}
    | {n: _is_spacing for n in ("margin", "padding")}
    | {n: lambda v: is_number(v) or _is_text(v) for n in ("width", "height")}
)
_SPACING_OWNERS = {"itemMargin": {"Row", "Column"}, "space": {"List"}}


def resolve(name: str, value: Any, where: str) -> Any:
    """Colour tokens as colours; older size tokens are errors. Nested values go by their own names, edges by their owner's."""
    if isinstance(value, dict):
        return {k: resolve(name if name in ("margin", "padding") else k, v, where) for k, v in value.items()}
    if isinstance(value, list):
        if name != "colors":
            return [resolve(name, v, where) for v in value]
        for stop in value:
            if not (isinstance(stop, list) and len(stop) == 2 and isinstance(stop[0], str) and isinstance(stop[1], (int, float))):
                raise CardError("gradient", f"{where}: a gradient stop is [colour, place]")
        return [[t.COLORS.get(c, c), p] for c, p in value]
    if isinstance(value, str):
        if name in t.COLOR_PROPERTIES:
            return t.COLORS.get(value, value)
        if name in t.TOKEN_AWARE and (value.startswith(t.LEGACY_PREFIXES) or value in t.LEGACY_SIZES):
            raise CardError("token", f"{where}: {name} has an undefined token {value}")
    return value


@cache
def allowed_properties(type_: str) -> frozenset[str]:
    own = t.ACTION_PROPERTIES if type_ == "ActionUnit" else frozenset()
    none: frozenset[str] = frozenset()
    return t.COMMON_STYLES | t.COMMON_PROPERTIES | own | t.FIELDS.get(type_, none) | t.DROPPED_FIELDS.get(type_, none) | t.STYLES.get(type_, none)


def _need(ok: bool, kind: str, message: str) -> None:
    if not ok:
        raise CardError(kind, message)


def _media(value: Any, where: str) -> None:
    _need(_is_text(value) and value.startswith(t.MEDIA_PREFIX), "source", f"{where}: an image lies under {t.MEDIA_PREFIX}")


def _label(props: dict, where: str) -> None:
    label = props.get("label")
    _need(isinstance(label, str) and label.strip() != "", "label", f"{where}: a label is text")


def _flag(props: dict, name: str, where: str) -> None:
    _need(name not in props or isinstance(props[name], bool) or is_bound(props[name]), "value", f"{where}: {name} is a boolean or bound")


def _check_action(props: dict, where: str) -> None:
    _need(not t.ACTION_SKIN & set(props), "skin", f"{where}: an action has no skin of its own")
    _need(props.get("state") in ("capsule", "icon-round"), "state", f"{where}: unknown state")
    _need("onClick" in props, "event", f"{where}: an action needs an event")
    if props["state"] == "capsule":
        _label(props, where)
        if props.get("icon") is not None:
            _media(props["icon"], where)
    else:
        _need("label" not in props, "label", f"{where}: a round icon has no label")
        _media(props.get("icon"), where)


def _check_meaning(type_: str, props: dict, where: str) -> None:
    if type_ == "Text":
        _need(isinstance(props.get("content"), str) or is_bound(props.get("content")), "value", f"{where}: content is text or bound")
    elif type_ == "Image":
        _media(props.get("src"), where)
    elif type_ == "Progress":
        for name in ("value", "total"):
            _need(name in props and (is_number(props[name]) or is_bound(props[name])), "value", f"{where}: {name} is a number or bound")
    elif type_ in ("Button", "ActionUnit"):
        _flag(props, "enabled", where)
    elif type_ == "Checkbox":
        for name in {"label", "value"} & set(props):
            _need(isinstance(props[name], str) or is_bound(props[name]), "value", f"{where}: {name} is text or bound")
        _flag(props, "select", where)


def _check_events(handlers: Any, where: str) -> None:
    _need(isinstance(handlers, list) and bool(handlers), "event", f"{where}: onClick is a list of handlers")
    for h in handlers:
        _need(isinstance(h, dict) and set(h) <= {"call", "args"}, "event", f"{where}: a handler has call and args")
        _need(_is_text(h.get("call")) and (h.get("args") is None or isinstance(h["args"], dict)), "event", f"{where}: a handler calls by name")


def check_properties(type_: str, props: dict, where: str) -> None:
    """All rules of one component's properties, in the order in which they decide the error."""
    _need(not t.LEGACY_PROPERTIES & set(props) and "functionCall" not in props, "legacy", f"{where}: an older property")
    for name, owners in _SPACING_OWNERS.items():
        _need(name not in props or type_ in owners, "spacing", f"{where}: {type_} has no {name}")
    for name, value in props.items():
        resolve(name, value, where)
    unknown = set(props) - allowed_properties(type_)
    _need(not unknown, "property", f"{where}: {type_} has no {', '.join(sorted(unknown))}")
    for name, value in props.items():
        _need(name not in VALUE_RULES or VALUE_RULES[name](value), "type", f"{where}: {name} has a wrong value")
    _need(t.REQUIRED.get(type_, "design") in props or type_ not in t.REQUIRED, "required", f"{where}: {type_} needs {t.REQUIRED.get(type_)}")
    if type_ == "Button" and props.get("design") != "icon-round":
        _label(props, where)
    if type_ == "ActionUnit":
        _check_action(props, where)
    _check_meaning(type_, props, where)
    if "onClick" in props:
        _check_events(props["onClick"], where)
    check_source(props, where)


# --- rows -----------------------------------------------------------------------------------------------------


def read_row(row: list[Any], number: int) -> Component | Data:
    """A JSON row as a data or component row."""
    data = None
    if len(row) == 2 and isinstance(row[0], str) and row[0].startswith("/"):
        data = row[0], row[1]
    elif len(row) == 3 and row[1] == "DataDef" and isinstance(row[2], dict) and "value" in row[2] and isinstance(row[2].get("path", "/"), str):
        data = row[2].get("path", "/"), row[2]["value"]
    if data:
        _pointer(data[0], "data")
        check_source(data[1], f"data {data[0]}")
        return Data(*data)
    if len(row) in (3, 4) and isinstance(row[2], dict) and "children" in row[2] and (len(row) == 4 or isinstance(row[2]["children"], list)):
        props = {k: v for k, v in row[2].items() if k != "children"}
        row = [row[0], row[1], props, row[3] if len(row) == 4 else row[2]["children"]]
    _need(len(row) in (3, 4), "shape", f"row {number} has a wrong shape")
    type_, props = modernise(*row[:3])
    _need(_is_text(row[0]), "header", f"row {number} has no id")
    id_ = row[0]
    _need(isinstance(type_, str) and type_ in t.TYPES, "header", f"{id_}: unknown component {type_}")
    _need(isinstance(props, dict), "header", f"{id_}: properties are an object")
    children = _children(row[3] if len(row) == 4 else None, type_, id_)
    if not (type_ == "Image" and props.get("src") == ""):
        check_properties(type_, props, id_)
    return Component(id_, type_, props, children)


def _children(value: Any, type_: str, where: str) -> tuple[str, ...]:
    holds = type_ in t.CONTAINERS
    if value is None:
        _need(not holds, "children", f"{where}: {type_} needs children")
        return ()
    _need(isinstance(value, list) and all(map(_is_text, value)), "children", f"{where}: children are ids")
    _need(len(value) == len(set(value)), "children", f"{where}: a child twice")
    _need(holds or type_ == "Button" or not value, "children", f"{where}: {type_} has no children")
    return tuple(value)


def _check_button_icons(components: list[Component]) -> None:
    by_id = {c.id: c for c in components}
    icons = set()
    for c in components:
        if c.type == "Button" and c.children:
            _need(len(c.children) == 1 and (icon := by_id.get(c.children[0])) is not None and icon.type == "Image", "icon", f"{c.id}: a button has one image")
            icons.add(c.children[0])
    parents = [k for c in components for k in c.children if k in icons]
    _need(len(parents) == len(icons), "icon", "a button's image has one parent")


def _preorder(components: list[Component]) -> list[Component] | None:
    """Components from the root down, or None if the tree is not whole."""
    by_id = {c.id: c for c in components}
    root = by_id.get("root")
    if len(by_id) != len(components) or root is None or root.type != "Column":
        return None
    out, seen, todo = [], set(), ["root"]
    while todo:
        id_ = todo.pop()
        if id_ in seen or id_ not in by_id:
            return None
        seen.add(id_)
        out.append(by_id[id_])
        todo.extend(reversed(by_id[id_].children))
    return out


@lru_cache(maxsize=4096)
def _sound_row(text: str) -> Component | Data | None:
    """The row of a text, None if it breaks a rule. Rows as a root or a button are alike in many cards; nobody changes a row."""
    try:
        return read_row(json.loads(text), 0)
    except (ValueError, TypeError, AttributeError, RecursionError):
        return None


def _read_rows(texts: list[str]) -> list[Component | Data]:
    """The rows in order, or the first error: those of JSON before those of rules."""
    rows = [_sound_row(x) for x in texts]
    if all(r is not None for r in rows):
        return rows
    return [read_row(r, n) for n, r in enumerate([row_value(x, n) for n, x in enumerate(texts, 1)], 1)]


def read_card(text: str) -> Card:
    """A card's rows: mended, modernised, checked, without empty images, in pre-order, with a sound tree."""
    found, mended = row_texts(strip_fence(text))
    rows = _read_rows(found)
    components = [r for r in rows if isinstance(r, Component)]
    _check_button_icons(components)
    empty = {c.id for c in components if c.type == "Image" and c.props.get("src") == ""}
    if empty:
        rows = [
            replace(r, children=tuple(k for k in r.children if k not in empty)) if isinstance(r, Component) else r
            for r in rows if isinstance(r, Data) or r.id not in empty
        ]
    components = [r for r in rows if isinstance(r, Component)]
    data = [r for r in rows if isinstance(r, Data)]
    order = _preorder(components)
    if order is not None:
        kept = {c.id for c in order}
        return Card(order, data, mended, [c.id for c in components if c.id not in kept])
    _check_order(rows)
    return Card(components, data, mended)


def _check_order(rows: list[Component | Data]) -> None:
    """Rows as they stand: the root first, parents before children, one parent each, nobody missing."""
    first = rows[0] if rows else None
    _need(isinstance(first, Component) and first.id == "root" and first.type == "Column", "root", "the root column is missing")
    seen, parent = set(), {}
    for c in (r for r in rows if isinstance(r, Component)):
        _need(c.id not in seen, "duplicate", f"{c.id} twice")
        _need(c.id == "root" or c.id in parent, "order", f"{c.id} is not announced by a parent")
        seen.add(c.id)
        for k in c.children:
            _need(k != "root" and k not in parent, "parent", f"{k} has two parents")
            parent[k] = c.id
    missing = set(parent) - seen
    _need(not missing, "missing", f"missing: {', '.join(sorted(missing))}")
