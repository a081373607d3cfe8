"""Checked rows to the component-tree document: designs, data model, emission."""

from __future__ import annotations

import hashlib
from functools import cache
from typing import Any

from ..functions.json import MISSING, pointer_get, pointer_parts
from . import tables as t
from .rows import CardError, Card, Component, binding_paths, compact, dump_rows, fresh, is_path, map_leaves, read_card, resolve


def expand(component: Component) -> Component:
    """The design's properties under the component's own, tokens resolved."""
    props = dict(component.props)
    design = props.pop("design", None)
    if design is not None:
        known = t.DESIGNS.get(component.type, {})
        if not isinstance(design, str) or design not in known:
            raise CardError("design", f"{component.id}: {component.type} has no design {design}")
        props = {**known[design], **props}
    return Component(component.id, component.type, {k: resolve(k, v, component.id) for k, v in props.items()}, component.children)


def design_styles(type_: str, design: str) -> dict[str, Any]:
    return {k: resolve(k, v, design) for k, v in t.DESIGNS[type_][design].items()}


# --- data model -----------------------------------------------------------------------------------------------


def merge(old: Any, new: Any, path: str) -> Any:
    """Objects by key and lists by index; null gives way; other values must agree."""
    if old is None:
        return fresh(new)
    if isinstance(old, dict) and isinstance(new, dict):
        return old | {k: merge(old.get(k), v, f"{path}/{k}") for k, v in new.items()}
    if isinstance(old, list) and isinstance(new, list):
        longest = max(len(old), len(new))
        pad = lambda x: x + [None] * (longest - len(x))
        return [a if i >= len(new) else merge(a, b, f"{path}/{i}") for i, (a, b) in enumerate(zip(pad(old), pad(new)))]
    if old == new:
        return old
    raise CardError("model", f"{path}: values do not agree")


def place(value: Any, parts: list[str], new: Any, path: str) -> Any:
    """``value`` with ``new`` merged in at the pointer's parts. A container is a list if the next part is a number."""
    if not parts:
        return merge(value, new, path)
    head, rest = parts[0], parts[1:]
    if isinstance(value, list):
        if not head.isdigit():
            raise CardError("model", f"{path}: {head} is no index")
        i = int(head)
        value = value + [None] * (i + 1 - len(value))
        value[i] = _descend(value[i], rest, new, path)
        return value
    return {**value, head: _descend(value.get(head), rest, new, path)}


def _descend(child: Any, rest: list[str], new: Any, path: str) -> Any:
    if rest:
        wanted = list if rest[0].isdigit() else dict
        if child is None:
            child = wanted()
        if not isinstance(child, wanted):
            raise CardError("model", f"{path}: crosses a value of another kind")
    return place(child, rest, new, path)


def data_model(card: Card) -> dict[str, Any]:
    if not card.data:
        return {"data": {}}
    model, seen = {}, {}
    for row in card.data:
        if row.path in seen and seen[row.path] != row.value:
            raise CardError("model", f"{row.path}: two values")
        seen[row.path] = row.value
        parts = pointer_parts(row.path)
        if not parts and not isinstance(row.value, dict):
            raise CardError("model", "the root is an object")
        model = place(model, parts, row.value, row.path)
    return model


def check_bindings(components: list[Component], model: dict[str, Any]) -> None:
    for c in components:
        for path in binding_paths(c.props):
            if pointer_get(model, path) is MISSING:
                raise CardError("unbound", f"{c.id}: {path} has no data")


# --- emission -------------------------------------------------------------------------------------------------


def written(value: Any) -> Any:
    """Bindings in their written form."""

    def one(v):
        if is_path(v):
            return "{{ ${" + v["path"] + "} }}"
        if isinstance(v, dict) and set(v) == {"expression"}:
            return "{{ " + v["expression"] + " }}"
        return v

    return map_leaves(value, one)


def root_gradient(seed: str) -> dict[str, Any]:
    index = int(hashlib.sha256(seed.encode("utf-8", "surrogatepass")).hexdigest()[:4], 16)
    return fresh(t.GRADIENTS[index % len(t.GRADIENTS)])


@cache
def _fields_beside_styles(type_: str) -> frozenset[str]:
    spacing = {"Row": {"itemMargin"}, "Column": {"itemMargin"}, "List": {"space"}}.get(type_, set())
    return t.FIELDS.get(type_, frozenset()) | {"onClick"} | spacing


def _emit_action(c: Component) -> list[dict[str, Any]]:
    head = {"id": c.id, "onClick": written(c.props["onClick"])}
    if c.props["state"] == "capsule":
        styles = design_styles("Button", "capsule")
        if c.props.get("actionInk") is not None:
            styles["fontColor"] = c.props["actionInk"]
        enabled = {"enabled": written(c.props["enabled"])} if "enabled" in c.props else {}
        return [{**head, "component": "Button", "label": c.props["label"], **enabled, "styles": styles}]
    icon = f"{c.id}_icon"
    styles = {**design_styles("Button", "icon-round"), "alignContent": "center", "clip": True}
    return [
        {**head, "component": "Stack", "children": [icon], "styles": styles},
        {"id": icon, "component": "Image", "src": c.props["icon"], "styles": dict(t.ICON_STYLES)},
    ]


def emit(c: Component, icon_button: bool, gradient: dict[str, Any]) -> list[dict[str, Any]]:
    """The document's components for one row: two for a round action icon, else one."""
    if c.type == "ActionUnit":
        return _emit_action(c)
    stacked = icon_button and bool(c.children)
    type_ = "Stack" if stacked else c.type
    out: dict[str, Any] = {"id": c.id, "component": type_}
    if type_ in t.CONTAINERS or c.children:
        out["children"] = list(c.children)
    if icon_button and not stacked:
        out["label"] = t.EMPTY_LABEL
    beside, hidden = _fields_beside_styles(c.type), t.DROPPED_FIELDS.get(c.type, frozenset()) | ({"label"} if icon_button else set())
    shown = {k: written(v) for k, v in c.props.items() if k not in hidden}
    out |= {k: v for k, v in shown.items() if k in beside}
    styles = {k: v for k, v in shown.items() if k not in beside}
    if c.id == "root":
        small = (c.props.get("width"), c.props.get("height")) == t.SIZES["2x2"]
        styles |= {"width": "matchParent", "height": "matchParent"}
        if small:
            styles |= t.ROOT_SHELL
            styles.setdefault("justifyContent", "spaceBetween")
            out["itemMargin"] = t.ROOT_ITEM_MARGIN
        if not {"linearGradient", "backgroundColor", "backgroundImage"} & set(styles):
            styles["linearGradient"] = fresh(gradient)
    if stacked:
        styles |= {"alignContent": "center", "clip": True}
    if c.type == "Text":
        styles.setdefault("maxLines", 1)
    if styles:
        out["styles"] = styles
    return [out]


def check_root_size(root: Component, size: str) -> None:
    if size not in t.SIZES:
        raise CardError("size", f"unknown size {size}")
    if (root.props.get("width"), root.props.get("height")) != t.SIZES[size]:
        raise CardError("size", f"the root is not of size {size}")


def check_surface(surface: Any) -> None:
    if not isinstance(surface, str) or not surface.strip():
        raise CardError("surface", "a surface has an id")


def to_document(text: str, size: str, version: str | None = None, surface: str = "surface_card") -> str:
    """A card as three messages, one a line: surface, components, data model."""
    check_surface(surface)
    return document_of(sound_card(text, size), text, size, version, surface)


def sound_card(text: str, size: str) -> tuple[Card, list[Component], dict[str, Any]]:
    """A card, its components with designs and tokens expanded, and its data model, which has what they bind."""
    card = read_card(text)
    check_root_size(card.components[0], size)
    expanded = [expand(c) for c in card.components]
    model = data_model(card)
    check_bindings(expanded, model)
    return card, expanded, model


def document_of(sound: tuple[Card, list[Component], dict[str, Any]], text: str, size: str, version: str | None, surface: str) -> str:
    check_surface(surface)
    card, expanded, model = sound
    gradient = root_gradient(text)
    round_buttons = {c.id for c in card.components if c.type == "Button" and c.props.get("design") == "icon-round"}
    components = [x for c in expanded for x in emit(c, c.id in round_buttons, gradient)]
    width, height = t.SIZES[size]
    head = {"version": str(version or t.DEFAULT_VERSION)}
    return dump_rows(
        [
            {**head, "createSurface": {"surfaceId": surface, "catalogId": t.CATALOG, "width": width, "height": height}},
            {**head, "updateComponents": {"surfaceId": surface, "root": "root", "components": components}},
            {**head, "updateDataModel": {"surfaceId": surface, "path": "/", "value": model}},
        ]
    )


def expand_tokens(text: str) -> str:
    """The card's rows with designs and tokens expanded."""
    card = read_card(text)
    return dump_rows([expand(c).row() for c in card.components] + [d.row() for d in card.data])
