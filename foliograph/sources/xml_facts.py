"""Facts of a package's XML parts, as they stand there: no rule and no inheritance is decided here."""

from __future__ import annotations

import re
from xml.etree import ElementTree
from xml.parsers import expat

from foliograph.functions.canonical import SPACE

#: Namespaces, transitional and strict, by the prefix that names here have.
NAMESPACES = {
    "http://schemas.openxmlformats.org/drawingml/2006/main": "a",
    "http://purl.oclc.org/ooxml/drawingml/main": "a",
    "http://schemas.openxmlformats.org/presentationml/2006/main": "p",
    "http://purl.oclc.org/ooxml/presentationml/main": "p",
    "http://schemas.openxmlformats.org/officeDocument/2006/relationships": "r",
    "http://purl.oclc.org/ooxml/officeDocument/relationships": "r",
    "http://schemas.openxmlformats.org/package/2006/relationships": "rel",
    "http://schemas.openxmlformats.org/package/2006/content-types": "ct",
}
KINDS = {"cxnSp": "connector", "contentPart": "content-part", "graphicFrame": "graphic-frame", "grpSp": "group", "pic": "picture", "sp": "shape"}
WRAPPERS = {"cxnSp": "nvCxnSpPr", "contentPart": "nvContentPartPr", "graphicFrame": "nvGraphicFramePr", "grpSp": "nvGrpSpPr", "pic": "nvPicPr", "sp": "nvSpPr"}
FILLS = frozenset("blipFill gradFill grpFill noFill pattFill solidFill".split())
COLOURS = frozenset("hslClr prstClr schemeClr scrgbClr srgbClr sysClr".split())
AUTOFITS = frozenset("noAutofit normAutofit spAutoFit".split())
EFFECTS = frozenset("blur fillOverlay softEdge".split())
MAX_SAFE = 2**53 - 1
INTEGER = re.compile(r"[+-]?\d+\Z", re.A)
BLANK = re.compile(f"[{SPACE}]*\\Z")
SKIPPED = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|(<!DOCTYPE)", re.S)
DECLARED = re.compile(r"<\?xml\s[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9._\-]+)[\"']")
#: Expat's code of an end tag that fits no start (fixed value).
MISMATCHED = 7


class Bad(ValueError):
    """Why a part can't be used; encodings and names have no position."""

    def __init__(self, code: str, message: str, line: int | None = None, column: int | None = None, offset: int | None = None) -> None:
        super().__init__(message)
        self.code, self.line, self.column, self.offset = code, line, column, offset


def parse(data: bytes) -> ElementTree.Element:
    """The root of a part; Bad with one of the codes dtd-prohibited, invalid-namespace, malformed-xml, unsupported-encoding."""
    encoding, skip = "utf-8", 0
    for start, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(start):
            encoding, skip = name, len(start)
            break
    else:
        encoding = {b"<\0": "utf-16-le", b"\0<": "utf-16-be"}.get(data[:2], "utf-8")
    try:
        text = data[skip:].decode(encoding)
    except UnicodeDecodeError:
        raise Bad("unsupported-encoding", f"the bytes are not {encoding}") from None
    declared = DECLARED.match(text)
    if declared:
        name = declared[1].lower()
        if name not in ({"utf-8"} if encoding == "utf-8" else {"utf-16", encoding.replace("-le", "le").replace("-be", "be")}):
            raise Bad("unsupported-encoding", f"the declared encoding {declared[1]} is not {encoding}")
    for m in SKIPPED.finditer(text):
        if m[1]:
            raise Bad("dtd-prohibited", "a document type declaration is not allowed", *position(text, m.start()))
    raw = data if encoding == "utf-8" and not skip else text.encode()
    try:
        return ElementTree.fromstring(raw, ElementTree.XMLParser(encoding="utf-8"))
    except ElementTree.ParseError as e:
        raise fault(text, raw, str(e)) from None


def position(text: str, at: int) -> tuple[int, int, int]:
    """Line, column and offset of a place in a text; columns and offsets count UTF-16 code units, columns and lines from 1."""
    units = lambda part: len(part) + sum(c > "\uffff" for c in part)
    before = text[:at]
    return before.count("\n") + 1, units(before[before.rfind("\n") + 1 :]) + 1, units(before)


def fault(text: str, raw: bytes, why: str) -> Bad:
    """What is wrong with XML that can't be parsed with namespaces.

    Where it is well-formed without them, its names or bindings are at fault, which have no position. Else the position is
    that of the token that can't stand there: of an end tag that fits no start, the tag's own.
    """
    plain = expat.ParserCreate("utf-8")
    try:
        plain.Parse(raw, True)
    except expat.ExpatError as e:
        at = len(raw[: plain.ErrorByteIndex].decode("utf-8", "ignore"))
        if e.code == MISMATCHED:
            at = text.rfind("</", 0, at + 2)
        return Bad("malformed-xml", expat.ErrorString(e.code), *position(text, at))
    return Bad("invalid-namespace", why.split(":")[0])


def name(e: ElementTree.Element) -> str:
    """prefix:local for known namespaces, else the local name after a mark that no prefix has."""
    if e.tag[:1] != "{":
        return e.tag
    uri, _, local = e.tag[1:].rpartition("}")
    return f"{NAMESPACES.get(uri, '?')}:{local}"


def kids(e: ElementTree.Element | None, *names: str) -> list[ElementTree.Element]:
    return [] if e is None else [c for c in e if name(c) in names]


def kid(e: ElementTree.Element | None, *path: str) -> ElementTree.Element | None:
    for step in path:
        e = next((c for c in e if name(c) == step), None) if e is not None else None
    return e


def attr(e: ElementTree.Element | None, key: str) -> str | None:
    return None if e is None else e.get(key)


def related(e: ElementTree.Element, key: str) -> str | None:
    return next((v for k, v in e.items() if k[:1] == "{" and NAMESPACES.get(k[1:].rpartition("}")[0]) == "r" and k.endswith("}" + key)), None)


def integer(raw: str | None) -> int | None:
    """A safe integer; else null."""
    if raw is None or not INTEGER.match(raw) or abs(int(raw)) > MAX_SAFE:
        return None
    return int(raw)


def boolean(e: ElementTree.Element | None, key: str) -> bool | None:
    """False where it is absent, null where it is invalid."""
    return {None: False, "1": True, "true": True, "0": False, "false": False}.get(attr(e, key))


def own_text(e: ElementTree.Element) -> str:
    return (e.text or "") + "".join(c.tail or "" for c in e)


def shows_text(e: ElementTree.Element) -> bool:
    return any(name(x) == "a:t" and not BLANK.match(own_text(x)) for x in e.iter())


def transform(e: ElementTree.Element | None) -> dict | None:
    """off, ext, chOff, chExt, rotation and flips; null fields are absent or invalid."""
    if e is None:
        return None
    off, ext, ch_off, ch_ext = (kid(e, f"a:{n}") for n in ("off", "ext", "chOff", "chExt"))
    rot = 0 if attr(e, "rot") is None else integer(attr(e, "rot"))
    return {
        "x": integer(attr(off, "x")), "y": integer(attr(off, "y")), "w": integer(attr(ext, "cx")), "h": integer(attr(ext, "cy")), "rot": rot,
        "flip_h": boolean(e, "flipH"), "flip_v": boolean(e, "flipV"),
        "ch_x": integer(attr(ch_off, "x")), "ch_y": integer(attr(ch_off, "y")), "ch_w": integer(attr(ch_ext, "cx")), "ch_h": integer(attr(ch_ext, "cy")),
    }


def properties(e: ElementTree.Element | None, kind: str, level: int | None = None, font_ref: str | None = None) -> dict | None:
    if e is None and font_ref is None:
        return None
    out = {"kind": kind, "level": level, "sz": attr(e, "sz"), "lang": attr(e, "lang"), "alt_lang": attr(e, "altLang"), "font_ref": font_ref}
    for slot in ("latin", "ea", "cs"):
        face = kid(e, f"a:{slot}")
        out[f"has_{slot}"], out[slot] = face is not None, attr(face, "typeface")
    return out


def levels(e: ElementTree.Element | None, kind: str) -> list[dict]:
    """Default run properties of a list style's levels 0 to 8."""
    found = [(n, kid(e, f"a:lvl{n + 1}pPr", "a:defRPr")) for n in range(9)]
    return [properties(x, kind, n) for n, x in found if x is not None]


def paragraph_level(p: ElementTree.Element) -> int | None:
    raw = attr(kid(p, "a:pPr"), "lvl")
    value = 0 if raw is None else integer(raw)
    return value if value is not None and 0 <= value <= 8 else None


def body(e: ElementTree.Element, at: int) -> dict:
    paragraphs, runs, defaults = kids(e, "a:p"), [], []
    for n, p in enumerate(paragraphs):
        level, default = paragraph_level(p), kid(p, "a:pPr", "a:defRPr")
        if default is not None and level is not None:
            defaults.append(properties(default, "paragraph", level))
        for k, r in enumerate(kids(p, "a:r", "a:fld")):
            t = kid(r, "a:t")
            text = "" if t is None else own_text(t)
            if not BLANK.match(text):
                runs.append({"paragraph": n, "run": k, "text": text, "level": level, "own": properties(kid(r, "a:rPr"), "run-properties"), "paragraph_default": properties(default, "paragraph-default")})
    choices = [{"choice": name(c)[2:], "scale": c.get("fontScale")} for c in kid(e, "a:bodyPr") or () if name(c) in {f"a:{x}" for x in AUTOFITS}]
    return {"idx": at, "autofit": choices, "paragraphs": defaults, "list_style": levels(kid(e, "a:lstStyle"), "list-style"), "runs": runs}


def fill(e: ElementTree.Element, tag: str) -> dict:
    holder = kid(e, "p:spPr")
    fills = [c for c in (() if holder is None else holder) if name(c)[:2] == "a:" and name(c)[2:] in FILLS]
    colours = [c for c in (fills[0] if len(fills) == 1 else ()) if name(c)[:2] == "a:" and name(c)[2:] in COLOURS]
    dag, effects = kid(holder, "a:effectDag"), kid(holder, "a:effectLst")
    blip = kid(e, "p:blipFill", "a:blip") if tag == "pic" else None
    steps = colours[0] if len(colours) == 1 else ()
    return {
        "has_properties": holder is not None, "fills": [name(c)[2:] for c in fills], "preset": attr(kid(holder, "a:prstGeom"), "prst"),
        "effects": dag is not None or any(name(c) in {f"a:{x}" for x in EFFECTS} for c in (() if effects is None else effects)),
        "colours": [name(c)[2:] for c in colours], "alphas": [{"op": name(c)[2:], "val": integer(c.get("val"))} for c in steps if name(c).startswith("a:alpha")],
        "has_blip": blip is not None, "embed": None if blip is None else related(blip, "embed"),
        "blip_effects": [{"op": name(c)[2:], "val": integer(c.get("amt"))} for c in (() if blip is None else blip) if name(c)[:2] == "a:"],
    }


def cells(e: ElementTree.Element) -> list[dict]:
    """Cells of the first table that show text, in units of its grid, with the grid's size."""
    table = next((x for x in e.iter() if name(x) == "a:tbl"), None)
    grid = kid(table, "a:tblGrid")
    if grid is None:
        return []
    positive = lambda x, key: v if (v := integer(attr(x, key))) is not None and v > 0 else None
    widths, rows = [positive(c, "w") for c in kids(grid, "a:gridCol")], kids(table, "a:tr")
    heights = [positive(r, "h") for r in rows]
    if not widths or not heights or None in widths or None in heights:
        return []
    out = []
    for r, row in enumerate(rows):
        column, own = 0, kids(row, "a:tc")
        for k, cell in enumerate(own):
            across, down = positive(cell, "gridSpan") or 1, positive(cell, "rowSpan") or 1
            merged = [boolean(c, "hMerge") is True for c in own[k : k + across]]
            w, h = sum(widths[column : column + across]), sum(heights[r : r + down])
            if not merged[0] and boolean(cell, "vMerge") is not True and w and h and shows_text(cell):
                out.append({"key": f"table:r{r}:c{column}", "x": sum(widths[:column]), "y": sum(heights[:r]), "w": w, "h": h, "grid_w": sum(widths), "grid_h": sum(heights)})
            column += 1 if merged[0] or across > 1 and sum(merged[1:]) == across - 1 else across
    return out


def shapes(root: ElementTree.Element) -> list[dict]:
    """Leaves of the shape tree in document order, each with its groups from the outside in."""
    out: list[dict] = []

    def walk(e: ElementTree.Element, groups: list[dict]) -> None:
        for c in e:
            tag = name(c)[2:] if name(c)[:2] == "p:" else ""
            if tag not in KINDS:
                continue
            marks = kid(c, f"p:{WRAPPERS[tag]}", "p:cNvPr")
            number = integer(attr(marks, "id"))
            own = {"id": number if number is not None and number >= 0 else None, "name": attr(marks, "name"), "hidden": boolean(marks, "hidden")}
            if tag == "grpSp":
                walk(c, [*groups, own | {"xfrm": transform(kid(c, "p:grpSpPr", "a:xfrm"))}])
                continue
            place = kid(c, f"p:{WRAPPERS[tag]}", "p:nvPr", "p:ph")
            font = attr(kid(c, "p:style", "a:fontRef"), "idx")
            texts = kids(c, "p:txBody") if tag in ("sp", "cxnSp") else [x for x in c.iter() if name(x) in ("p:txBody", "a:txBody")] if tag == "graphicFrame" else []
            out.append(own | {
                "kind": KINDS[tag], "groups": groups, "xfrm": transform(kid(c, "p:xfrm") if tag in ("graphicFrame", "contentPart") else kid(c, "p:spPr", "a:xfrm")),
                "ph": None if place is None else {"type": place.get("type", "obj"), "idx": place.get("idx", "0")},
                "fill": fill(c, tag), "shows_text": tag == "sp" and any(shows_text(t) for t in texts[:1]), "cells": cells(c) if tag == "graphicFrame" else [],
                "font_ref": properties(None, "font-reference", None, font) if font in ("major", "minor") else None, "bodies": [body(t, n) for n, t in enumerate(texts)],
            })

    tree = kid(root, "p:cSld", "p:spTree")
    if tree is not None:
        walk(tree, [])
    return out


def fonts(root: ElementTree.Element) -> list[dict]:
    scheme = next((x for x in root.iter() if name(x) == "a:fontScheme"), None)
    out = []
    for family in ("majorFont", "minorFont"):
        for c in kid(scheme, f"a:{family}") if kid(scheme, f"a:{family}") is not None else ():
            slot = name(c)[2:] if name(c)[:2] == "a:" else ""
            if slot in ("latin", "ea", "cs", "font"):
                out.append({"family": family, "slot": slot, "script": c.get("script"), "typeface": c.get("typeface")})
    return out


def facts(root: ElementTree.Element) -> dict:
    """Everything of a part that later steps use, by the root's name."""
    kind, out = name(root), {"root": name(root)}
    if kind == "ct:Types":
        out["types"] = [{"kind": name(c)[3:], "key": attr(c, "PartName" if name(c) == "ct:Override" else "Extension"), "content_type": attr(c, "ContentType")} for c in kids(root, "ct:Default", "ct:Override")]
    elif kind == "rel:Relationships":
        out["rels"] = [{"id": attr(c, "Id"), "type": attr(c, "Type"), "target": attr(c, "Target"), "mode": attr(c, "TargetMode")} for c in kids(root, "rel:Relationship")]
    elif kind == "p:presentation":
        size = kid(root, "p:sldSz")
        out["size"] = {"cx": integer(attr(size, "cx")), "cy": integer(attr(size, "cy"))}
        out["slide_ids"] = [{"id": attr(c, "id"), "rid": related(c, "id")} for c in kids(kid(root, "p:sldIdLst"), "p:sldId")]
        out["styles"] = levels(kid(root, "p:defaultTextStyle"), "presentation-default-text-style")
    elif kind in ("p:sld", "p:sldLayout", "p:sldMaster"):
        out["shapes"] = shapes(root)
        if kind == "p:sldMaster":
            out["styles"] = [x for s in ("title", "body", "other") for x in levels(kid(root, "p:txStyles", f"p:{s}Style"), f"master-{s}-text-style")]
    elif kind == "a:theme":
        out["fonts"] = fonts(root)
    return out
