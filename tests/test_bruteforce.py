"""The rules against plain scans over random texts."""

import random
import re
from collections import Counter

import pytest

from codegauge.operators.catalog import DEFAULT_RULES, SHORT_NAMES_ALLOWED, switched

PIECES = [
    "<?php ", "?>", "\n", "\n", "\n    ", "\n\t", " " * 24, "if", " ", "else if", "elseif (", "foreach (", "case 1:",
    "function foo_bar(", "function go", "() {", ") {", "}", "{", "public function get($a) ", "class foo ",
    "class Bar_x\n", "class Ok {", "/** doc */", "/* if */", "// while\n", "# for\n", "'", '"', "$a", "$b = 1",
    "$i", "$I ", "->if", "&&", "||", "\nuse Foo;\n", "\nuse A\\Foo as Bar;\n", "\nuse  Baz ;", " Foo ", " Bar",
    "rand(", "mt_rand (", 'shell_exec("x $y', 'system("$z', '")', '$q = "SELECT $z"', '$q="update $z\'',
    "echo $_GET['k'];", "\ninclude $_POST", "require_once($_COOKIE", "password = 'abc'", "é", "x" * 70,
    "declare(strict_types=1);", ";", "\r\n", "api_key='0123456789'", "y" * 130, "\n" * 30, "z" * 190, " \n", "$if",
]


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randrange(1, 90))) for _ in range(n)]


def line_at(data, offset):
    return data.count(b"\n", 0, offset) + 1


def by_patterns(data):
    for rule in DEFAULT_RULES:
        for k, p in enumerate(rule.patterns):
            regex = re.compile(f"{p.lead}(?P<reported>{p.body}){p.trail}".encode(), re.I)
            for m in regex.finditer(data):
                name = m["reported"].decode("latin-1")
                if rule.rule_id == "SHORT_VARIABLE_NAME" and name in SHORT_NAMES_ALLOWED:
                    continue
                if rule.rule_id == "NAMING_CONVENTION_CLASS" and re.fullmatch("[A-Z][a-zA-Z0-9]*", name):
                    continue
                yield rule.rule_id, k, line_at(data, m.start("reported")), 0


def long_functions(data):
    for m in re.finditer(rb"function\s+(\w+)\s*\([^)]*\)\s*\{", data, re.I):
        depth, at = 1, m.end()
        while depth and at < len(data):
            depth += {ord("{"): 1, ord("}"): -1}.get(data[at], 0)
            at += 1
        n = data.count(b"\n", m.end(), at)
        if n > 50:
            yield "FUNCTION_TOO_LONG", 0, line_at(data, m.start()), n


def undocumented(data):
    for rule, regex in (
        ("MISSING_DOCUMENTATION", rb"public\s+function\s+\w+\s*\([^)]*\)"),
        ("MISSING_CLASS_DOCUMENTATION", rb"class\s+\w+"),
    ):
        for m in re.finditer(regex, data, re.I):
            start = max(0, m.start() - 200)
            if not re.search(rb"/\*\*.*?\*/", data[start : start + 200], re.S):
                yield rule, 0, line_at(data, m.start()), 0


def line_rules(data):
    lines = data.split(b"\n")
    spaces = [i for i, line in enumerate(lines, 1) if line.startswith(b"    ")]
    tabs = [i for i, line in enumerate(lines, 1) if line.startswith(b"\t")]
    if spaces and tabs:
        yield "INCONSISTENT_INDENTATION", 0, max(spaces[0], tabs[0]), 0
    for i, line in enumerate(lines, 1):
        level = (len(line) - len(line.lstrip(b" \t\n\r\0\x0b"))) // 4
        if level > 4:
            yield "DEEP_NESTING", 0, i, level
        if len(line) > 120:
            yield "LINE_TOO_LONG", 0, i, len(line)
        if line and line[-1:] in b" \t\r\x0b\x0c":
            yield "TRAILING_WHITESPACE", 0, i, 0


def unused(data):
    for m in re.finditer(rb"^use\s+([\w\\]+)(?:\s+as\s+(\w+))?\s*;", data, re.M):
        short = m[2] or m[1].split(b"\\")[-1]
        if not re.search(rb"(?<!use\s)\b" + re.escape(short) + rb"\b", data):
            yield "UNUSED_IMPORT", 0, line_at(data, m.start()), 0


def complexity(data):
    """A small scanner: text outside the tags, comments and quotes are skipped."""
    points, at, inside = 1, 0, False
    words = {b"if", b"elseif", b"else", b"switch", b"case", b"while", b"for", b"foreach", b"catch"}
    skip = re.compile(
        rb"/\*.*?(?:\*/|\Z)|(?://|#(?!\[))(?:(?!\?>)[^\n])*|'(?:[^'\\]|\\.)*(?:'|\Z)|\"(?:[^\"\\]|\\.)*(?:\"|\Z)", re.S
    )
    word = re.compile(rb"(->\s*)?[$\\]?[A-Za-z_\x80-\xff][\w\x80-\xff\\]*|\d\w*")
    while at < len(data):
        if not inside:
            tag = re.compile(rb"<\?(?:php(?=\s|\Z)|=)", re.I).search(data, at)
            if not tag:
                break
            at, inside = tag.end(), True
            continue
        if data.startswith(b"?>", at):
            at, inside = at + 2, False
            continue
        quiet = skip.match(data, at)
        if quiet and quiet.end() > at:
            at = quiet.end()
            continue
        token = word.match(data, at)
        if token:
            points += token[0].lower() in words
            at = token.end()
            continue
        if data[at : at + 2] in (b"&&", b"||"):
            points, at = points + 1, at + 2
            continue
        at += 1
    return points


@pytest.mark.parametrize("seed", [11, 12])
def test_random_texts(analyze, seed):
    files = [(f"f{i}.txt", t) for i, t in enumerate(texts(seed, 400))]
    by_path, issues = analyze(files, switched("TRAILING_WHITESPACE", True))
    for path, text in files:
        data = text.encode()
        expected = [*by_patterns(data), *long_functions(data), *undocumented(data), *line_rules(data), *unused(data)]
        points = complexity(data)
        assert by_path[path]["cyclomatic_complexity"] == points, text
        if points > 20:
            expected.append(("HIGH_COMPLEXITY", 0, 1, 0))
        lines = data.count(b"\n") + 1
        if lines > 500:
            expected.append(("FILE_TOO_LONG", 0, 1, 0))
        numbered = {"FUNCTION_TOO_LONG", "DEEP_NESTING", "LINE_TOO_LONG"}
        got = []
        for i in issues[path]:
            n = int(re.findall(r"\d+", i["message"])[-1]) if i["rule_id"] in numbered else 0
            got.append((i["rule_id"], i["pattern_order"], i["line_number"], n))
        only_got, only_expected = Counter(got) - Counter(expected), Counter(expected) - Counter(got)
        assert (only_got, only_expected) == (Counter(), Counter()), repr(text)
        row = by_path[path]
        assert (row["code_length"], row["lines_of_code"]) == (len(data), lines)
        assert row["function_count"] == len(re.findall(rb"\bfunction\s+\w+\s*\(", data, re.I))
        assert row["class_count"] == len(re.findall(rb"\bclass\s+\w+", data, re.I))
