"""Fixed values of the card language: names, properties, tokens, designs."""

from __future__ import annotations

CATALOG = "ohos.a2ui.extended.catalog.form"
DEFAULT_VERSION = "v0.9"
EMPTY_LABEL = "​"
MEDIA_PREFIX = "resources/base/media/"

# Component types, their own fields and styles.
CONTAINERS = frozenset(("Row", "Column", "List", "Stack"))
TYPES = CONTAINERS | frozenset(("Text", "Image", "Divider", "Progress", "Button", "ActionUnit", "Checkbox"))
FIELDS = {
    "Text": frozenset(("content",)),
    "Image": frozenset(("src",)),
    "Progress": frozenset(("value", "total")),
    "Button": frozenset(("label", "enabled")),
    "ActionUnit": frozenset(("label", "enabled")),
    "Checkbox": frozenset(("label", "value", "select")),
}
DROPPED_FIELDS = {"Progress": frozenset({"threshold"})}
REQUIRED = {"Text": "content", "Image": "src", "Progress": "value"}
COMMON_STYLES = frozenset((
    "alignSelf", "aspectRatio", "backgroundColor", "backgroundImage", "backgroundImageSizeWithStyle", "borderColor", "borderRadius", "borderWidth",
    "clip", "constraintSize", "flexShrink", "height", "layoutWeight", "linearGradient", "margin", "maxHeight", "maxWidth", "minHeight", "minWidth",
    "opacity", "padding", "shadow", "visibility", "width",
))
STYLES = {
    "Text": frozenset(("fontColor", "fontSize", "fontWeight", "maxFontSize", "maxLines", "minFontSize", "textAlign")),
    "Image": frozenset(("fillColor", "objectFit")),
    "Divider": frozenset(("color", "strokeWidth", "vertical")),
    "Progress": frozenset(("color", "strokeWidth", "type")),
    "Button": frozenset(("backgroundColor", "borderRadius", "fontColor", "fontSize", "fontWeight", "maxFontSize", "maxLines", "minFontSize")),
    "Checkbox": frozenset(("mark", "selectedColor", "shape", "unSelectedColor")),
    "Row": frozenset(("alignItems", "itemMargin", "justifyContent")),
    "Column": frozenset(("alignItems", "itemMargin", "justifyContent")),
    "List": frozenset(("listDirection", "scrollBar", "space")),
    "Stack": frozenset(("alignContent",)),
}
COMMON_PROPERTIES = frozenset(("design", "onClick"))
ACTION_PROPERTIES = frozenset(("state", "icon", "actionInk"))
ACTION_SKIN = frozenset((
    "backgroundColor", "borderColor", "borderRadius", "borderWidth", "color", "design", "fillColor", "fontColor", "fontSize", "fontWeight", "height",
    "layoutWeight", "linearGradient", "maxFontSize", "maxLines", "minFontSize", "opacity", "padding", "textAlign", "textOverflow", "width",
))
NUMBERS = frozenset((
    "borderRadius", "borderWidth", "flexShrink", "fontSize", "layoutWeight", "maxFontSize", "maxHeight", "maxLines", "maxWidth", "minFontSize",
    "minHeight", "minWidth", "opacity", "strokeWidth",
))
BOUND_NUMBERS = frozenset({"layoutWeight"})
BOOLEANS = frozenset(("clip", "vertical"))
STRINGS = frozenset((
    "alignContent", "alignItems", "alignSelf", "backgroundImage", "backgroundImageSizeWithStyle", "listDirection", "objectFit", "scrollBar", "shape",
    "textAlign", "type", "visibility", "state", "icon", "actionInk",
))
EDGES = frozenset(("top", "right", "bottom", "left"))
LEGACY_PROPERTIES = frozenset(("action", "event", "submit_form"))
FORBIDDEN_FRAGMENTS = ("{{", "$item", "$__dataModel")
OPERATORS = (
    "===", "!==", "==", "!=", ">=", "<=", "&&", "||", "+", "-", "*", "/", "%", "?", ":", ">", "<", "!", "(", ")",
)
LEGACY_PREFIXES = ("padding_level", "corner_radius_level", "font_weight_")
LEGACY_SIZES = frozenset((
    "Display_L", "Display_M", "Display_S", "Title_L", "Title_M", "Title_S", "Subtitle_L", "Subtitle_M", "Subtitle_S", "Body_L", "Body_M", "Body_S",
    "Caption_L", "Caption_M",
))
TOKEN_AWARE = frozenset((
    "borderRadius", "fontSize", "fontWeight", "height", "itemMargin", "margin", "maxHeight", "maxWidth", "minHeight", "minWidth", "padding", "space",
    "strokeWidth", "width",
))
COLOR_PROPERTIES = frozenset((
    "backgroundColor", "borderColor", "color", "fillColor", "fontColor", "actionInk", "selectedColor", "shadowColor", "strokeColor",
    "unSelectedColor",
))
SIZES = {"2x2": (160, 160), "2x4": (320, 160), "4x2": (320, 160)}
FENCES = frozenset(("```", "```genui", "```json", "```text", "```designcompactdsl", "```design-compact-dsl"))
DOCUMENT_FENCES = frozenset(("```", "```genui", "```jsonl", "```json"))

# Colour tokens.
COLORS = {
    "font_primary": "#E5000000",
    "font_secondary": "#99000000",
    "font_tertiary": "#66000000",
    "font_emphasize": "#FF0A59F7",
    "font_on_primary": "#FFFFFFFF",
    "warning": "#FFE84026",
    "alert": "#FFED6F21",
    "confirm": "#FF64BB5C",
    "icon_primary": "#E5000000",
    "icon_secondary": "#99000000",
    "icon_tertiary": "#66000000",
    "icon_fourth": "#33000000",
    "icon_emphasize": "#FF0A59F7",
    "icon_on_primary": "#FFFFFFFF",
    "icon_on_secondary": "#99FFFFFF",
    "icon_on_tertiary": "#66FFFFFF",
    "icon_on_fourth": "#33FFFFFF",
    "background_primary": "#FFFFFFFF",
    "background_emphasize": "#FF0A59F7",
    "comp_background_list_card": "#FFFFFFFF",
    "comp_background_emphasize": "#FF0A59F7",
    "comp_background_tertiary": "#0C000000",
    "comp_background_secondary": "#19000000",
    "comp_background_primary_contrary": "#FFFFFFFF",
    "comp_divider": "#33000000",
    "container40": "#66000000",
    "primary50": "#7F000000",
    "multi_color_01": "#FF564AF7",
    "multi_color_02": "#FF46B1E3",
    "multi_color_03": "#FF61CFBE",
    "multi_color_04": "#FF64BB5C",
    "multi_color_05": "#FFA5D61D",
    "multi_color_06": "#FFAC49F5",
    "multi_color_07": "#FFE64566",
    "multi_color_08": "#FFE84026",
    "multi_color_09": "#FFED6F21",
    "multi_color_10": "#FFF9A01E",
    "multi_color_11": "#FFF7CE00",
    "multi_color_aux_01": "#FF8981F7",
    "multi_color_aux_02": "#FF86C5E3",
    "multi_color_aux_03": "#FF92D6CC",
    "multi_color_aux_04": "#FF92C48D",
    "multi_color_aux_05": "#FFBDDB69",
    "multi_color_aux_06": "#FFC386F0",
    "multi_color_aux_07": "#FFE67C92",
    "multi_color_aux_08": "#FFE87361",
    "multi_color_aux_09": "#FFED955F",
    "multi_color_aux_10": "#FFF9BC64",
    "multi_color_aux_11": "#FFF5DC62",
    "mask_primary": "#CC000000",
    "mask_secondary": "#99000000",
    "mask_tertiary": "#66000000",
    "mask_fourth": "#33000000",
    "mask_fifth": "#19000000",
    "mask_sixth": "#0C000000",
}

# Root gradients.
GRADIENTS = [
    {"angle": 145, "colors": [["#FFFFFFFF", 0.0], ["#FFF4FBFF", 0.44], ["#FF86C5E3", 1.0]]},
    {"angle": 145, "colors": [["#FFFFFFFF", 0.0], ["#FFEAF9F3", 0.46], ["#FF8FDCCC", 1.0]]},
    {"angle": 145, "colors": [["#FFFFFFFF", 0.0], ["#FFF0FBF8", 0.44], ["#FF92D6CC", 1.0]]},
    {"angle": 145, "colors": [["#FFFFFFFF", 0.0], ["#FFFFF7CC", 0.46], ["#FFFFE066", 1.0]]},
    {"angle": 145, "colors": [["#FFFFFFFF", 0.0], ["#FFFFF1E6", 0.46], ["#FFFFC58F", 1.0]]},
    {"angle": 145, "colors": [["#FFFFFFFF", 0.0], ["#FFF5EFFF", 0.44], ["#FFCBB7FF", 1.0]]},
    {"angle": 145, "colors": [["#FFFFFFFF", 0.0], ["#FFFFEFF4", 0.44], ["#FFFFB8CA", 1.0]]},
    {"angle": 145, "colors": [["#FFFFFFFF", 0.0], ["#FFF2F8FF", 0.44], ["#FFBCD6FF", 1.0]]},
]

# Designs, in the order in which they are matched.
DESIGNS = {
    "Text": {
        "display-l": {"fontSize": 56, "fontWeight": 300},
        "display-m": {"fontSize": 48, "fontWeight": 300},
        "display-s": {"fontSize": 36, "fontWeight": 700},
        "title-l": {"fontSize": 30, "fontWeight": 700},
        "title-m": {"fontSize": 24, "fontWeight": 700},
        "title-s": {"fontSize": 20, "fontWeight": 700},
        "subtitle-l": {"fontSize": 18, "fontWeight": 500},
        "subtitle-m": {"fontSize": 16, "fontWeight": 500},
        "subtitle-s": {"fontSize": 14, "fontWeight": 500},
        "body-l": {"fontSize": 16, "fontWeight": 500},
        "body-m": {"fontSize": 14, "fontWeight": 400},
        "body-s": {"fontSize": 12, "fontWeight": 400},
        "caption-l": {"fontSize": 12, "fontWeight": 500},
        "caption-m": {"fontSize": 10, "fontWeight": 500},
        "card-title": {"fontSize": 14, "fontWeight": 700},
        "hero-value": {"fontSize": 28, "fontWeight": 700},
        "hero-label": {"fontSize": 12, "fontWeight": 400},
        "meta-text": {"fontSize": 12, "fontWeight": 400},
    },
    "Image": {
        "icon-lg": {"width": "matchParent", "height": "matchParent", "aspectRatio": 1.0, "borderRadius": 8, "objectFit": "cover", "clip": True, "flexShrink": 0},
        "source-icon": {"width": 20, "height": 20, "objectFit": "contain", "flexShrink": 0},
        "hero-icon": {"width": 36, "height": 36, "objectFit": "contain", "flexShrink": 0},
    },
    "Button": {
        "capsule": {
            "width": "matchParent", "height": 30, "borderRadius": 15, "padding": {"left": 8, "top": 0, "right": 8, "bottom": 0}, "backgroundColor": "#190A59F7",
            "fontColor": "font_emphasize", "fontSize": 14, "fontWeight": 700, "maxFontSize": 14, "minFontSize": 12, "maxLines": 1, "flexShrink": 0,
        },
        "icon-round": {"width": 30, "height": 30, "borderRadius": 15, "padding": 0, "backgroundColor": "comp_background_tertiary", "flexShrink": 0},
    },
    "Progress": {
        "linear-bar": {"type": "linear", "width": "matchParent", "height": 8, "borderRadius": 4, "backgroundColor": "comp_background_secondary"},
        "linear-bar-small": {"type": "linear", "width": "matchParent", "height": 4, "borderRadius": 2, "backgroundColor": "comp_background_secondary"},
        "segmented-bar": {"type": "linear", "width": "matchParent", "height": 8, "borderRadius": 4, "backgroundColor": "comp_background_secondary"},
        "threshold-bar": {"type": "linear", "width": "matchParent", "height": 20, "borderRadius": 10, "backgroundColor": "#6B7F91", "color": "#C8F000"},
        "ring": {"type": "ring", "width": "matchParent", "height": "matchParent", "strokeWidth": 6, "backgroundColor": "comp_background_secondary", "color": "multi_color_10"},
    },
    "Divider": {
        "line": {"strokeWidth": 1, "vertical": False, "color": "comp_divider"},
        "bar": {"strokeWidth": 8, "vertical": False, "color": "comp_background_tertiary"},
    },
    "Checkbox": {
        "default": {
            "width": 20, "height": 20, "borderRadius": 10, "selectedColor": "#FF0A59F7", "unSelectedColor": "#66000000",
            "mark": {"strokeColor": "#FFFFFFFF", "size": 20, "strokeWidth": 2}, "shape": "circle",
        },
        "check": {
            "width": 16, "height": 16, "borderRadius": 4, "selectedColor": "icon_on_fourth", "unSelectedColor": "icon_tertiary",
            "mark": {"strokeColor": "icon_on_primary", "size": 16, "strokeWidth": 2}, "shape": "rounded_square",
        },
    },
}
ICON_STYLES = {"width": 16, "height": 16, "objectFit": "contain", "flexShrink": 0}
ROOT_SHELL = {"padding": 12, "borderRadius": 20, "clip": True}
ROOT_ITEM_MARGIN = 8

# Older spellings.
JUSTIFY_ALIASES = {"space-between": "spaceBetween", "space-around": "spaceAround", "space-evenly": "spaceEvenly", "flex-start": "start", "flex-end": "end"}
ALIGN_ALIASES = {
    "Row": {"flex-start": "top", "start": "top", "flex-end": "bottom", "end": "bottom"},
    "Column": {"flex-start": "start", "top": "start", "flex-end": "end", "bottom": "end"},
}
