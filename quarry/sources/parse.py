"""Symbols, edges, facts, call sites and aliases out of source text.

One scanner serves all languages: comments and string contents are blanked, a
table of declaration patterns per language finds what is declared on a line, and
braces give each declaration its end and its owner. It reads a file once, line
by line; parse_files() runs it over a DataFrame of files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quarry.functions.text import string_literals
from quarry.operators.lines import SECRET_MARKERS
from quarry.sources.files import LANGUAGES, resolve_import

_ID = r"[A-Za-z_$][\w$]*"
_MODS = r"(?:(?:export|default|declare|abstract|public|private|protected|internal|static|final|sealed|partial|async|override|virtual|readonly|synchronized|unsafe|extern|pub(?:\([^)]*\))?)\s+)*"
_TYPE = r"[\w.<>\[\],?&:' ]+?"

#: language: (pattern with a group name, kind) in order; kind method means: of the owner.
DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "typescript": [
        (rf"^\s*{_MODS}(?:class|interface|enum)\s+(?P<name>{_ID})", "class"),
        (rf"^\s*{_MODS}function\s*\*?\s*(?P<name>{_ID})", "function"),
        (rf"^\s*{_MODS}type\s+(?P<name>{_ID})[^=;]*=", "variable"),
        (rf"^\s*{_MODS}(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|{_ID}\s*=>)", "function"),
        (rf"^{_MODS}(?:const|let|var)\s+(?P<name>{_ID})", "variable"),
        (rf"^\s*{_MODS}(?:get\s+|set\s+)?\*?(?P<name>#?{_ID})\s*(?:<[^>]*>)?\([^;]*\)?\s*(?::\s*[^={{;]+)?\{{", "method"),
        (rf"^\s*{_MODS}(?P<name>#?{_ID})\s*[?!]?\s*(?::[^=;(]+)?(?:=[^>].*)?;\s*$", "field"),
    ],
    "go": [
        (rf"^func\s+\(\s*(?:{_ID}\s+)?\*?(?P<owner>{_ID})(?:\[[^\]]*\])?\s*\)\s*(?P<name>{_ID})", "method"),
        (rf"^func\s+(?P<name>{_ID})", "function"),
        (rf"^\s*type\s+(?P<name>{_ID})(?:\[[^\]]*\])?\s+struct", "class"),
        (rf"^\s*type\s+(?P<name>{_ID})(?:\[[^\]]*\])?\s+interface", "interface"),
        (rf"^\s*type\s+(?P<name>{_ID})", "variable"),
        (rf"^(?:const|var)\s+(?P<name>{_ID})", "variable"),
    ],
    "java": [
        (rf"^\s*{_MODS}(?:class|interface|enum|record|@interface)\s+(?P<name>{_ID})", "class"),
        (rf"^\s*{_MODS}(?:<[^>]+>\s*)?(?:(?!return\b|new\b|else\b|throw\b){_TYPE}\s+)?(?P<name>{_ID})\s*\([^;]*\)?\s*(?:throws\s+[\w., ]+)?(?:\{{|;\s*$|,\s*$|\(\s*$)", "method"),
        (rf"^\s*{_MODS}(?!return\b|new\b|import\b|package\b|throw\b){_TYPE}\s+(?P<name>{_ID})\s*(?:=.*)?;\s*$", "field"),
    ],
    "rust": [
        (rf"^\s*{_MODS}(?:const\s+)?fn\s+(?P<name>{_ID})", "method"),
        (rf"^\s*{_MODS}(?:struct|trait|enum|union)\s+(?P<name>{_ID})", "class"),
        (rf"^\s*{_MODS}(?:const|static)\s+(?:mut\s+)?(?P<name>{_ID})\s*:", "variable"),
        (rf"^\s*{_MODS}type\s+(?P<name>{_ID})", "variable"),
        (rf"^\s*macro_rules!\s*(?P<name>{_ID})", "macro"),
    ],
}
DECLARATIONS["javascript"] = DECLARATIONS["typescript"]
DECLARATIONS["csharp"] = [
    (rf"^\s*{_MODS}(?:class|struct|interface|enum|record(?:\s+struct|\s+class)?)\s+(?P<name>{_ID})", "class"),
    DECLARATIONS["java"][1],
    (rf"^\s*{_MODS}(?!return\b|new\b|using\b|namespace\b|throw\b){_TYPE}\s+(?P<name>{_ID})\s*(?:=[^>].*;|;|\{{\s*(?:get|set|init).*)\s*$", "field"),
]
_DECLARED = {lang: [(re.compile(p), kind) for p, kind in rules] for lang, rules in DECLARATIONS.items()}
_WORDS = {"if", "for", "while", "switch", "catch", "match", "return", "sizeof", "typeof", "await", "loop", "unsafe", "function", "new", "else", "do", "super", "constructor", "foreach", "using", "lock", "func", "fn"}

# Callees that say little; what gives a line away.
GENERIC_CALLEES = set("log println print debug info warn error map filter then catch unwrap expect clone to_string to_owned get set push insert".split())
_ERRORS = ("throw ", "new error", "panic!", "anyhow!", "bail!", "errors.new", "fmt.errorf", "return err", "invalid")
_FLAGS = ("feature", "flag", "isenabled", "launchdarkly")
_COMMANDS = ("command::new", "cmd(", "exec(", "spawn(", "command(", "new command", "std::process::command")
_ENV_CALLS = ("env::var(", "System.getenv(", "os.Getenv(", "Deno.env.get(", "Environment.GetEnvironmentVariable(")
_SECRET = re.compile("|".join(SECRET_MARKERS), re.I)


@dataclass
class Parsed:
    symbols: list[tuple] = field(default_factory=list)  # name, kind, line, end_line, context
    edges: list[tuple] = field(default_factory=list)  # source, target, relationship, target_file, original
    facts: list[tuple] = field(default_factory=list)  # fact_type, value, line, enclosing
    callsites: list[tuple] = field(default_factory=list)  # line, callee, receiver, target, arguments, aliases, enclosing, confidence, generic
    aliases: list[tuple] = field(default_factory=list)  # line, local, imported, source, kind


def blanked(source: str, language: str) -> list[str]:
    """The lines with comments and the contents of strings blanked out."""
    comment = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
    quotes = r'"(?:[^"\\\n]|\\.)*"' + (r"|'(?:[^'\\\n]|\\.)'" if language == "rust" else r"|'(?:[^'\\\n]|\\.)*'") + r"|`(?:[^`\\]|\\.)*`"

    def blank(m: re.Match) -> str:
        t = m[0]
        hide = lambda s: re.sub(r"[^\n]", " ", s)
        return hide(t) if t[0] == "/" else t[0] + hide(t[1:-1]) + t[-1]

    return re.sub(f"{comment}|{quotes}", blank, source, flags=re.S).split("\n")


def _owner(stack: list[tuple]) -> str | None:
    return next((s[0] for s in reversed(stack) if s[1] in ("class", "interface", "impl")), None)


def parse(source: str, file: str) -> Parsed:
    language = LANGUAGES.get(file.rsplit(".", 1)[-1].lower(), "")
    out = Parsed()
    raw = source.split("\n")
    if language:
        _structure(out, raw, blanked(source, language), language, file)
    _signals(out, raw, file)
    return out


def _structure(out: Parsed, raw: list[str], code: list[str], language: str, file: str) -> None:
    rules, stack, depth = _DECLARED[language], [], 0  # stack: (name, kind, depth, index of its symbol)
    spans: list[list] = []
    for no, line in enumerate(code, 1):
        owner = _owner(stack)
        inside = any(s[1] in ("function", "method") for s in stack)
        found = None
        if language == "rust" and (m := re.match(r"^\s*impl\b(?:<[^>]*>)?\s+(?:(?P<trait>[\w:]+)(?:<[^>]*>)?\s+for\s+)?(?P<type>\w+)", line)):
            if m["trait"]:
                trait = m["trait"].split("::")[-1]
                out.edges += [(m["type"], trait, "implements", None, None), (trait, m["type"], "implemented_by", None, None)]
            found = (m["type"], "impl")
        elif not inside or language in ("rust",):
            for pattern, kind in rules:
                m = pattern.match(line)
                if not m or m["name"] in _WORDS or (kind in ("method", "field") and not owner and "owner" not in pattern.groupindex and language != "rust"):
                    continue
                if kind in ("method", "field") and owner and stack and depth != stack[-1][2] + 1 and language != "rust":
                    continue
                name = m["name"]
                if kind == "method" and language == "rust" and not owner:
                    kind = "function"
                top = m.groupdict().get("owner") or (owner if kind in ("method", "field", "class") and language != "go" else None)
                kind = "variable" if kind == "field" else kind
                full = f"{top}.{name}" if top and kind != "function" else name
                found = (full, kind)
                spans.append([full, kind, no, no])
                _bases(out, line, full, language)
                break
        for c in line:
            if c == "{":
                if found:
                    stack.append((*found, depth, len(spans) - 1 if found[1] != "impl" else None))
                    found = None
                depth += 1
            elif c == "}":
                depth -= 1
                while stack and stack[-1][2] >= depth:
                    s = stack.pop()
                    if s[3] is not None:
                        spans[s[3]][3] = no
        if language == "rust" and stack and stack[-1][1] == "class" and (m := re.match(r"^\s*([A-Z]\w*)\s*(?:[({,]|$)", line)) and re.search(rf"\benum\s+{re.escape(stack[-1][0])}\b", code[spans[stack[-1][3]][2] - 1]) and no != spans[stack[-1][3]][2]:
            spans.append([f"{stack[-1][0]}.{m[1]}", "variable", no, no])
        here = next((s[0] for s in reversed(stack) if s[1] in ("function", "method")), None)
        if here or (spans and spans[-1][2] == no and spans[-1][1] in ("function", "method")):
            _calls(out, line, here or spans[-1][0], declared=spans[-1][0].split(".")[-1] if spans and spans[-1][2] == no else None)
    for name, kind, first, last in spans:
        out.symbols.append((name, kind, first, max(first, last), "\n".join(raw[first - 1 : min(last, first + 9)])))
    _imports(out, raw, language, file)


def _bases(out: Parsed, line: str, name: str, language: str) -> None:
    split = lambda s: [re.sub(r"<.*", "", b).strip().split("(")[0].strip() for b in re.sub(r"<[^<>]*>", "", s).split(",") if b.strip()]
    if language == "csharp":
        if m := re.search(r"(?:class|struct|interface|record)\s+\w+(?:<[^>]*>)?(?:\([^)]*\))?\s*:\s*([^{]+)", line):
            for b in split(m[1].split(" where ")[0]):
                out.edges += [(name, b, "extends", None, None), (b, name, "extended_by", None, None)]
        return
    for word, there, back in (("extends", "extends", "extended_by"), ("implements", "implements", "implemented_by")):
        if m := re.search(rf"\b{word}\s+([^{{]+?)(?:\bimplements\b|\bextends\b|\{{|$)", line):
            for b in split(m[1]):
                out.edges += [(name, b, there, None, None), (b, name, back, None, None)]


def _calls(out: Parsed, line: str, source: str, declared: str | None) -> None:
    for m in re.finditer(rf"(?P<new>\bnew\s+)?(?P<target>{_ID}(?:(?:\.|::|\?\.)#?{_ID})*)\s*!?\(", line):
        target = m["target"].replace("?.", ".").replace("::", ".")
        last = target.split(".")[-1]
        if last in _WORDS or last == declared or target == source or target.startswith("console."):
            continue
        made = m["new"] or (last[0].isupper() and "." not in target)
        out.edges.append((source, target, "instantiates" if made else "calls", None, None))


def _imports(out: Parsed, raw: list[str], language: str, file: str) -> None:
    text = "\n".join(raw)
    add = lambda module, name, original: out.edges.append((None, name, "imports", resolve_import(file, module), original))
    if language in ("javascript", "typescript"):
        for m in re.finditer(r"import\s+(?:type\s+)?([^'\";]+?)\s+from\s+['\"]([^'\"]+)['\"]", text):
            spec, module = m[1], m[2]
            if b := re.search(r"\{([^}]*)\}", spec):
                for part in filter(None, map(str.strip, b[1].split(","))):
                    p = re.sub(r"^type\s+", "", part).split(" as ")
                    add(module, p[-1].strip(), p[0].strip())
            head = re.sub(r"\{[^}]*\}", "", spec).strip(" ,")
            if head:
                add(module, re.sub(r"^\*\s*as\s+", "", head), "*" if head.startswith("*") else "default")
        for m in re.finditer(rf"(?:const|let|var)\s+(\{{[^}}]*\}}|{_ID})\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)", text):
            names = m[1].strip("{}").split(",")
            for part in filter(None, map(str.strip, names)):
                p = part.split(":")
                add(m[2], p[-1].strip(), p[0].strip())
    elif language == "go":
        for block in re.findall(r"^import\s*\(([^)]*)\)|^import\s+(.+)$", text, re.M):
            for alias, path in re.findall(r"([\w.]+)?\s*\"([^\"]+)\"", block[0] or block[1]):
                add(path, alias or path.split("/")[-1], path)
    elif language == "java":
        for path in re.findall(r"^\s*import\s+(?:static\s+)?([\w.]+);", text, re.M):
            add(path, path.split(".")[-1], path)
    elif language == "csharp":
        for alias, path in re.findall(r"^\s*using\s+(?:(\w+)\s*=\s*)?([\w.]+);", text, re.M):
            add(path, alias or path.split(".")[-1], path)
    elif language == "rust":
        for body in re.findall(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", text, re.M):
            for path, alias in _use_paths(re.sub(r"\s+", " ", body)):
                add(path, alias or path.split("::")[-1], path)


def _use_paths(body: str, prefix: str = "") -> Iterator[tuple[str, str | None]]:
    """Full paths of a use tree with their aliases."""
    body = body.strip()
    if m := re.match(r"^(.*?)\{(.*)\}$", body):
        depth, part = 0, ""
        for c in m[2] + ",":
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                if part.strip():
                    yield from _use_paths(part, prefix + m[1])
                part = ""
            else:
                part += c
    elif body:
        path, _, alias = body.partition(" as ")
        full = prefix + path.strip()
        yield full.removesuffix("::self"), alias.strip() or None


def _signals(out: Parsed, raw: list[str], file: str) -> None:
    manifest = {"package.json": "package", "Cargo.toml": "toml", "pyproject.toml": "toml"}.get(file.rsplit("/", 1)[-1])
    scripts = False
    _aliases(out, raw)
    known = {a[1]: a[3] for a in out.aliases}
    spans = sorted(out.symbols, key=lambda s: s[3] - s[2])
    seen: set[tuple] = set()
    for no, line in enumerate(raw, 1):
        owner = next((s[0] for s in spans if s[2] <= no <= s[3]), None)
        secret, low = bool(_SECRET.search(line)), line.lower()
        if not secret:
            facts = [("environment_variable", v) for v in re.findall(r"(?:process\.env|import\.meta\.env)\.(\w+)", line)]
            facts += [("environment_variable", v[0]) for call in _ENV_CALLS if call in line and (v := string_literals(line.split(call, 1)[1]))]
            if manifest == "package":
                scripts = line.strip().startswith('"scripts"') or (scripts and not line.strip().startswith("}"))
                if m := re.match(r'\s*"([^"]+)"\s*:\s*"([^"]*)"', line):
                    facts += [("package_name", m[2])] if m[1] == "name" else [("script_name", m[1]), ("command", (m[2].split() or [m[2]])[0])] if scripts else []
            elif manifest == "toml" and (m := re.match(r'\s*name\s*=\s*"([^"]*)"', line)):
                facts.append(("package_name", m[1]))
            for text in string_literals(line):
                facts += _literal_facts(text, low, manifest is not None)
            for f in facts:
                if f[1] and (key := (*f, no, owner)) not in seen:
                    seen.add(key)
                    out.facts.append((f[0], f[1][:240], no, owner))
        if LANGUAGES.get(file.rsplit(".", 1)[-1].lower()):
            _callsites(out, line, no, owner, known, secret)


def _literal_facts(text: str, low: str, manifest: bool) -> list[tuple[str, str]]:
    value, t = text.lower(), text.strip()
    if not t:
        return []
    useful = 2 <= len(t.encode()) <= 200 and any(c.isalpha() for c in t)
    out = []
    if value.endswith((".json", ".yaml", ".yml", ".toml")) and ("/" in value or "config" in value or "package" in value):
        out.append(("config_path", text))
    for kind, marks in (("error_string", _ERRORS), ("feature_flag", _FLAGS)):
        if useful and any(m in low for m in marks):
            out.append((kind, text))
    if useful and any(m in low for m in _COMMANDS):
        out.append(("command", text.split()[0]))
    if manifest and ("/" in text or value.endswith((".json", ".yaml", ".yml", ".toml", ".rs", ".ts", ".js"))):
        out.append(("manifest_path", text))
    if useful and not low.lstrip().startswith("import ") and "require(" not in low and (any(c in text for c in "/._-") or (len(text) >= 12 and len(text.split()) >= 2)):
        out.append(("important_string", text))
    return out


def _close(line: str, at: int) -> int | None:
    """The place of the bracket that closes the one at at, quotes regarded."""
    depth, quote, k = 0, "", at
    while k < len(line):
        c = line[k]
        if quote:
            k += c == "\\"
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return k
        k += 1
    return None


def _arguments(text: str, secret: bool) -> list[str]:
    parts, depth, quote, part = [], 0, "", ""
    for c in text + ",":
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        depth += 0 if quote else (c in "([{") - (c in ")]}")
        if c == "," and not depth and not quote:
            parts.append(part.strip())
            part = ""
        else:
            part += c
    out = []
    for p in [p for p in parts if p][:8]:
        if p[0] in "\"'`":
            out.append("string:" + ("<redacted>" if secret or _SECRET.search(p) else p.strip("\"'`")[:80]))
        elif re.fullmatch(r"-?[\d._]+\w*", p):
            out.append(f"number:{p}")
        elif p in ("true", "false"):
            out.append(f"boolean:{p}")
        elif p[0] in "{[":
            out.append("object" if p[0] == "{" else "array")
        elif m := re.match(r"([\w.:$]+)\(", p):
            out.append(f"call:{m[1]}")
        else:
            out.append("identifier:" + ("<redacted>" if secret else p[:80]))
    return out


def _callsites(out: Parsed, line: str, no: int, owner: str | None, known: dict[str, str], secret: bool) -> None:
    at = 0
    while (open_ := line.find("(", at)) >= 0:
        at = open_ + 1
        m = re.search(r"([\w$.:]+)$", line[:open_])
        target = m[1].strip(".:") if m else ""
        before = line[: m.start()].rstrip() if m else ""
        if not target or target.split(".")[-1] in _WORDS or target[0].isdigit() or re.search(r"\b(?:function|func|fn|def|class)$", before):
            continue
        close = _close(line, open_)
        if close is None:
            continue
        receiver, _, callee = target.rpartition(".") if "." in target else target.rpartition("::")
        base = re.split(r"[.:]", receiver or callee)[0]
        via = [f"{base}->{known[base]}"] if base in known else []
        generic = callee in GENERIC_CALLEES
        sure = min(1.0, (0.35 if generic else 0.65) + (0.10 if receiver else 0) + (0.20 if via else 0))
        row = (no, callee, receiver or None, target, _arguments(line[open_ + 1 : close], secret), via, owner, round(sure, 2), generic)
        if not any(c[0] == no and c[3] == target and c[6] == owner for c in out.callsites[-8:]):
            out.callsites.append(row)
        at = close + 1


def _aliases(out: Parsed, raw: list[str]) -> None:
    seen = set()

    def add(no: int, local: str, imported: str, source: str, kind: str) -> None:
        if local and (key := (local, imported, source, no)) not in seen:
            seen.add(key)
            out.aliases.append((no, local, imported, source, kind))

    for no, line in enumerate(map(str.strip, raw), 1):
        quoted = string_literals(line)
        if line.startswith(('import "', "import (")):
            for path in quoted:
                add(no, path.split("/")[-1], path.split("/")[-1], path, "go_import")
        elif line.startswith("import ") and " from " in line and quoted:
            spec = line[6:].split(" from ")[0].strip()
            head = re.sub(r"\{[^}]*\}", "", spec).strip(" ,")
            if head.startswith("* as "):
                add(no, head[5:].strip(), "*", quoted[-1], "namespace_import")
            elif head:
                add(no, head, "default", quoted[-1], "default_import")
            if b := re.search(r"\{([^}]*)\}", spec):
                for part in filter(None, map(str.strip, b[1].split(","))):
                    p = part.split(" as ")
                    add(no, p[-1].strip(), p[0].strip(), quoted[-1], "named_import")
        elif line.startswith("import ") and (source := line[7:].rstrip(";").strip()) and " " not in source:
            kind = "side_effect" if source[0] in "\"'" else "java_import"
            source = source.strip("\"'")
            add(no, source.split(".")[-1] if kind == "java_import" else source, source.split(".")[-1] if kind == "java_import" else source, source, kind)
        elif re.match(r"(?:const|let|var)\s", line) and "require(" in line and quoted:
            for part in re.sub(r"^(?:const|let|var)\s+", "", line.split("=")[0]).strip(" {}").split(","):
                p = part.split(":")
                add(no, p[-1].strip(), p[0].strip(), quoted[0], "require")
        elif line.startswith("use "):
            for path, alias in _use_paths(line[4:].rstrip(";")):
                last = path.split("::")[-1]
                add(no, alias or last, last, path, "rust_use")
        elif line.startswith("using ") and "=" in line:
            local, source = line[6:].rstrip(";").split("=", 1)
            add(no, local.strip(), source.strip(), source.strip(), "using_alias")


def module_candidates(language: str, module: str) -> list[str]:
    """Files that a module path can stand for, the likeliest first."""
    if language in ("javascript", "typescript"):
        kinds = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
        return [module, *(f"{module}.{k}" for k in kinds), *(f"{module}/index.{k}" for k in kinds)]
    if language == "rust":
        path = re.sub(r"^(?:crate|self|super)::", "", module).replace("::", "/")
        roots = (path, path.rsplit("/", 1)[0])
        return [f"{base}{r}{end}" for r in roots for base in ("", "src/") for end in (".rs", "/mod.rs")]
    if language == "java":
        return [f"{base}{module.replace('.', '/')}.java" for base in ("", "src/main/java/", "src/")]
    if language == "csharp":
        return [f"{module.replace('.', '/')}.cs", f"{module.rsplit('.', 1)[-1]}.cs"]
    return [module]


def resolve_module(language: str, module: str, files: set[str]) -> str | None:
    """The first candidate among files, as a whole or as the end of a path."""
    for c in module_candidates(language, module):
        if c in files:
            return c
        ends = sorted(f for f in files if f.endswith("/" + c))
        if ends:
            return ends[0]
    return None


PARSED = "file string, what string, row string"
#: Schemas of the JSON rows, by what.
ROWS = {
    "symbols": "name string, kind string, line long, end_line long, context string",
    "edges": "source string, target string, relationship string, target_file string, original string",
    "facts": "fact_type string, value string, line long, enclosing string",
    "callsites": "line long, callee string, receiver string, target string, arguments array<string>, aliases array<string>, enclosing string, confidence double, generic boolean",
    "aliases": "line long, local_name string, imported_name string, source string, alias_kind string",
}


def parse_files(files: DataFrame) -> DataFrame:
    """files: file, content. PARSED: one row per thing found, as JSON; a file that
    cannot be parsed gives one row of what 'error'. Read once, split by table() after."""
    names = {w: [c.split()[0] for c in s.split(", ")] for w, s in ROWS.items()}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index
            for k in range(0, batch.num_rows, 64):
                part, out = batch.slice(k, 64), []
                for file, content in zip(part.column(at("file")).to_pylist(), part.column(at("content")).to_pylist()):
                    try:
                        got = parse((content or b"").decode("utf-8", "replace"), file)
                    except Exception as e:  # one bad file is counted, the others go on
                        out.append((file, "error", json.dumps({"message": str(e)[:200]})))
                        continue
                    for what, cols in names.items():
                        out += [(file, what, json.dumps(dict(zip(cols, row)))) for row in getattr(got, what)]
                cols = list(zip(*out)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["file", "what", "row"])

    return files.select("file", "content").mapInArrow(run, PARSED)


def table(parsed: DataFrame, what: str) -> DataFrame:
    from pyspark.sql import functions as F

    return parsed.where(F.col("what") == what).select("file", F.from_json("row", ROWS[what]).alias("r")).select("file", "r.*")
