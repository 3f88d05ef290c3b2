"""API descriptions as trees: references, merged schemas, security, and what is derived from an operation.

Trees are never changed in place; every function returns new ones.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from callgauge.functions.text import MEDIA_TYPES, RESPONSES

# Methods that count as operations, levels of references put in place, verbs of the embedding texts,
# and the primitive types of the type declarations.
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
LEVELS = 2
VERBS = {
    "get": ("Get", "Read", "Fetch", "Retrieve"),
    "put": ("Put", "Update", "Modify"),
    "post": ("Post", "Create", "Add", "Append", "Insert"),
    "delete": ("Delete", "Remove"),
    "options": ("Check", "Inspect"),
    "patch": ("Patch", "Modify", "Update"),
}
PRIMITIVES = {"string": "string", "number": "number", "integer": "number", "boolean": "boolean", "null": "null"}
UNKNOWN = "{ /* ... */ }"


def pointer(root: dict, ref: str):
    """What a JSON pointer of this document names."""
    if not ref.startswith("#"):
        raise ValueError(f"external reference: {ref}")
    at = root
    for part in ref[1:].split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        try:
            at = at[int(part)] if isinstance(at, list) else at[part]
        except (KeyError, IndexError, ValueError, TypeError):
            raise ValueError(f"unresolved reference: {ref}") from None
    return at


def inlined(node, root: dict, levels: int = LEVELS, seen: frozenset = frozenset()):
    """``node`` with references replaced by what they name, to a depth; deeper ones become the name as a type.

    Members beside a reference win over the component's. A component that is an array takes its name as type.
    """
    if isinstance(node, list):
        return [inlined(x, root, levels, seen) for x in node]
    if not isinstance(node, dict):
        return node
    ref = node.get("$ref")
    if not isinstance(ref, str):
        return {k: inlined(v, root, levels, seen) for k, v in node.items()}
    beside, name = {k: v for k, v in node.items() if k != "$ref"}, ref.rsplit("/", 1)[-1]
    if levels == 0:
        return {**beside, "type": name}
    if ref in seen:
        raise ValueError(f"cycle of references: {ref}")
    target = pointer(root, ref)
    if isinstance(target, dict) and target.get("type") == "array":
        target = {**target, "type": name}
    return {**inlined(target, root, levels - 1, seen | {ref}), **beside}


def deep_merge(a: dict, b: dict) -> dict:
    """Lists concatenate, objects merge, else the second wins."""
    out = dict(a)
    for k, v in b.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = deep_merge(out[k], v)
        elif isinstance(v, list) and isinstance(out.get(k), list):
            out[k] = out[k] + v
        else:
            out[k] = v
    return out


def without_all_of(node):
    """``allOf`` folded into its parent, inner ones first; the parent's own members win."""
    if isinstance(node, list):
        return [without_all_of(x) for x in node]
    if not isinstance(node, dict):
        return node
    node = {k: without_all_of(v) for k, v in node.items()}
    parts = node.pop("allOf", None)
    if not isinstance(parts, list):
        return node
    merged: dict = {}
    for part in parts:
        merged = deep_merge(merged, part if isinstance(part, dict) else {})
    return deep_merge(merged, node)


def security_parameters(spec: dict, operation: dict) -> list[dict]:
    """Credentials as parameters: schemes of the document and the operation together, descriptions of one name and place joined; required if it is the only one."""
    named = sorted({n for held in (spec.get("security"), operation.get("security")) for need in held or [] for n in need})
    schemes = spec.get("components", {}).get("securitySchemes", {})
    found: dict[tuple[str, str], list[str]] = {}
    for name in named:
        scheme = schemes.get(name, {})
        kind = scheme.get("type")
        if kind == "apiKey" and scheme.get("in") in ("header", "query"):
            key = (scheme["name"], scheme["in"])
        elif kind in ("http", "oauth2"):
            key = ("Authorization", "header")
        else:
            continue
        texts = found.setdefault(key, [])
        if (text := scheme.get("description", "")) and text not in texts:
            texts.append(text)
    return [{"name": n, "in": where, "required": len(found) == 1, "description": " | ".join(texts), "schema": {"type": "string"}} for (n, where), texts in found.items()]


def prepared(spec: dict, levels: int = LEVELS) -> dict:
    """References in place, ``allOf`` folded, path-level members pushed down, credentials as parameters."""
    paths = {}
    for path, item in (spec.get("paths") or {}).items():
        item = without_all_of(inlined(item, spec, levels))
        shared, out = item.get("parameters") or [], {}
        for method, operation in item.items():
            if method not in METHODS or not isinstance(operation, dict):
                continue
            own = operation.get("parameters") or []
            have = {(p.get("name"), p.get("in")) for p in own}
            params = own + [p for p in shared if (p.get("name"), p.get("in")) not in have] + security_parameters(spec, operation)
            operation = {**{k: item[k] for k in ("summary", "description") if k in item}, **{k: v for k, v in operation.items() if k != "security"}}
            out[method] = {**operation, **({"parameters": params} if params else {})}
        paths[path] = out
    return {**{k: v for k, v in spec.items() if k not in ("security", "paths")}, "paths": paths}


def preferred_content(content: dict) -> tuple[str, dict]:
    """The media type to go by and its object."""
    name = next((m for m in MEDIA_TYPES if m in content), next(iter(content)))
    return name, content[name] if isinstance(content[name], dict) else {}


def body_schema(operation: dict) -> dict | None:
    content = (operation.get("requestBody") or {}).get("content")
    return (preferred_content(content)[1].get("schema") or {}) if content else None


def operations(spec: dict) -> Iterator[tuple[str, str, dict]]:
    """(path, method, operation) of a prepared document."""
    for path, item in spec.get("paths", {}).items():
        for method, operation in item.items():
            yield path, method, operation


def property_names(schema: dict, prefix: str = "", depth: int = 1) -> list[str]:
    """Dotted names of properties to a depth, required ones marked."""
    out, required = [], schema.get("required") if isinstance(schema.get("required"), list) else []
    for name, sub in (schema.get("properties") or {}).items():
        full = f"{prefix}{name}"
        out.append(full + (" (required)" if name in required else ""))
        if depth > 0 and isinstance(sub, dict):
            inner = sub.get("items") if sub.get("type") == "array" and isinstance(sub.get("items"), dict) else sub
            out += property_names(inner, f"{full}.", depth - 1)
    return out


def embedding_texts(path: str, method: str, operation: dict) -> list[str]:
    """Up to five texts of an operation; those without content are left out."""
    import yaml

    told, verbs = operation.get("description", ""), ", ".join(VERBS.get(method, (method,)))
    head = f"{told}, using {verbs} on {path}.\n"
    out = [f"'{told}', using '{verbs}' on '{path}'"]
    if params := operation.get("parameters"):
        out.append(f"{head}Supported parameters: " + "  \n".join(f"{p.get('name')}: {p.get('description', '')}" for p in params))
    if (body := body_schema(operation)) is not None:
        out.append(f"{head}Supported request body: " + ", ".join(property_names(body)))
    responses = {str(k): v for k, v in (operation.get("responses") or {}).items()}
    answer = next((responses[k] for k in RESPONSES if isinstance(responses.get(k), dict)), None)
    if answer and answer.get("content"):
        media = preferred_content(answer["content"])[1]
        if schema := media.get("schema"):
            out.append(f"{head}Supported response schema: {yaml.safe_dump(schema, sort_keys=False)}")
        if (example := media.get("example")) is not None:
            out.append(f"{head}Supported response example:\n{yaml.safe_dump(example, sort_keys=False)}")
    return out


def comment(text: str, target: int = 100) -> str:
    """The first line, shortened behind a full stop near the target, else before its last space."""
    line = (text or "").strip().split("\n")[0]
    if len(line) <= target:
        return line
    if (stop := line[: target + 50].rfind(".")) >= 0:
        return line[: stop + 1]
    return line[: space if (space := line[:target].rfind(" ")) >= 0 else target]


def _block(lines: list[str]) -> str:
    return "{\n" + "\n".join("  " + x for line in lines for x in line.split("\n")) + "\n}" if lines else "{}"


def _field(name: str, kind: str, required: bool, note: str = "") -> str:
    bare = name if re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", name) else json.dumps(name)
    return f"{bare}{'' if required else '?'}: {kind}" + (f" // {note}" if note and not kind.startswith("{\n") else "")


def type_of(schema, notes: bool = True) -> str:
    """A schema as a type. A property counts as required unless it says otherwise itself."""
    if not isinstance(schema, dict):
        return UNKNOWN
    if isinstance(schema.get("enum"), list) and schema["enum"]:
        return " | ".join(json.dumps(v) for v in schema["enum"])
    kind = schema.get("type")
    if isinstance(kind, list):
        return " | ".join(dict.fromkeys(PRIMITIVES.get(k, UNKNOWN) for k in kind if isinstance(k, str))) or UNKNOWN
    if kind in PRIMITIVES:
        return PRIMITIVES[kind]
    if kind == "array":
        return type_of(schema.get("items") or {}, False) + "[]"
    if isinstance(schema.get("properties"), dict):
        return _block([_field(n, type_of(s, False), bool((s or {}).get("required", True)), comment((s or {}).get("description", ""), 50) if notes else "") for n, s in schema["properties"].items()])
    return kind or UNKNOWN


def type_declaration(path: str, method: str, operation: dict) -> str:
    """An operation as a declaration of its request's type, by place of its parameters and body."""
    fields = []
    for where in ("path", "query", "header"):
        held = [p for p in operation.get("parameters") or [] if p.get("in") == where]
        if held:
            fields.append(f"{where}: " + _block([_field(p["name"], type_of(p.get("schema")), bool(p.get("required", where == "path")), comment(p.get("description", ""), 50)) for p in held]))
    body = operation.get("requestBody")
    if isinstance(body, dict) and body.get("content"):
        fields.append(f"requestBody{'' if body.get('required', True) else '?'}: {type_of(body_schema(operation))}")
    source = operation.get("operationId") or method + re.sub(r"\{[^{}]*\}", "", path)
    name = "".join(p[:1].upper() + p[1:] for p in re.split("[^A-Za-z0-9]+", source)) + "Request"
    return f"// {method.upper()} {path}\n// {comment(operation.get('summary') or operation.get('description') or '')}\ntype {name} = {_block(fields)}"


def resolved(node, root: dict, seen: frozenset = frozenset()):
    """``node`` with references in place to any depth; one that leads back to itself, or nowhere, is an empty object."""
    if isinstance(node, list):
        return [resolved(x, root, seen) for x in node]
    if not isinstance(node, dict):
        return node
    ref = node.get("$ref")
    if not isinstance(ref, str):
        return {k: resolved(v, root, seen) for k, v in node.items()}
    if ref in seen:
        return {}
    try:
        return resolved(pointer(root, ref), root, seen | {ref})
    except ValueError:
        return {}


def formatted_schema(schema) -> dict:
    """What a reader needs of a schema: type, description, enum, items and properties, ``allOf`` folded, required names once each."""
    schema = without_all_of(schema) if isinstance(schema, dict) else {}
    out = {k: schema[k] for k in ("type", "description", "enum", "format") if k in schema}
    if isinstance(schema.get("items"), dict):
        out["items"] = formatted_schema(schema["items"])
    if isinstance(schema.get("properties"), dict):
        out["properties"] = {k: formatted_schema(v) for k, v in schema["properties"].items()}
    if isinstance(schema.get("required"), list):
        out["required"] = list(dict.fromkeys(schema["required"]))
    return out


def endpoint(path: str, method: str, operation: dict) -> dict:
    """An operation as a flat record: its texts, parameters, body and answers."""
    first = " ".join(re.split(r"[.!?]", operation.get("description") or "")[0].split()[:20])
    body = body_schema(operation)
    return {
        "method": method,
        "path": path,
        "summary": operation.get("summary") or first,
        "description": operation.get("description") or "",
        "operation_id": operation.get("operationId") or "",
        "parameters": [{"name": p.get("name"), "in": p.get("in"), "required": bool(p.get("required")), "description": p.get("description", ""), "schema": formatted_schema(p.get("schema"))} for p in operation.get("parameters") or []],
        "body": formatted_schema(body) if body is not None else None,
        "responses": {str(k): (v or {}).get("description", "") for k, v in (operation.get("responses") or {}).items()},
    }


def endpoint_text(e: dict) -> str:
    """The text that an endpoint is found by."""
    marks = lambda p: " | ".join([*(["required"] if p["required"] else []), f"in: {p['in']}", f"type: {p['schema'].get('type', 'any')}"])
    lines = [f"{e['method'].upper()} {e['path']}", e["summary"], e["description"], e["operation_id"]]
    lines += [f"{p['name']} [{marks(p)}] {p['description']}".rstrip() for p in e["parameters"]]
    if e["body"]:
        lines.append("body: " + ", ".join(property_names(e["body"])))
    return "\n".join(x for x in lines if x)
