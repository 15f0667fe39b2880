"""X7 against programs that are generated together with their skeletons."""

from __future__ import annotations

import random
import time

import pytest

from ctxengine.functions.scripts import skeleton
from ctxengine.functions.text import STUB

# (text, its skeleton with S for a stub; None: unchanged)
CASES = [
    ("function a() { return 1; }", "function a() S"),
    ("export default function () { return 1 }", "export default function () S"),
    ("const f = function() { return 1; };", None),
    ("const f = async function() { return 1; };", None),
    ("let a = 1\nexport default async function () { return 1 }", "let a = 1\nexport default async function () S"),
    ("const a = 1\nfunction b(): {x: number} { return {x:1} }", "const a = 1\nfunction b(): {x: number} S"),
    ("class A { constructor(x) { this.f = () => { go() } } get y() { return 1 } foo<T>(a: T): void { if (a) { b } } }", "class A { constructor(x) { this.f = () => S } get y() { return 1 } foo<T>(a: T): void S }"),
    ("class A {\n x = 1\n foo() { a }\n @Input() bar: string\n static async baz() { b }\n h = () => { c }\n}", "class A {\n x = 1\n foo() S\n @Input() bar: string\n static async baz() S\n h = () => S\n}"),
    ("const o = { a: function() { q }, b() { w }, get c() { e }, d: () => { r }, 'e'() { t }, [f]() { y }, async g() { u } };", "const o = { a: function() { q }, b() S, get c() { e }, d: () => S, 'e'() S, [f]() S, async g() S };"),
    ("if (a) { b } else { c }\nfor (;;) { d }\nwhile (x) { y }\ntry { z } catch (e) { f }", None),
    ("const s = '{ => {'; // () => {\n/* function a() { */ const r = /[{/]\\}/g; x.map(y => { return '}' })", "const s = '{ => {'; // () => {\n/* function a() { */ const r = /[{/]\\}/g; x.map(y => S)"),
    ("const t = `a ${b.map(c => { return `}${c}` })} { it's`; function z() { k }", "const t = `a ${b.map(c => S)} { it's`; function z() S"),
    ("interface U { id: ID; m(): void }\nexport type F = () => { x: number };\nenum E { A }", None),
    ("namespace N { export function f() { a } }", "namespace N { export function f() S }"),
    ("foo(function() { a }); bar(() => { b }); const g = (a): {x: 1} => { c };", "foo(function() { a }); bar(() => S); const g = (a): {x: 1} => S;"),
    ("function f() { a", None),
    ("const q = a / b; function h() { c } const z = d / e;", "const q = a / b; function h() S const z = d / e;"),
    ("abstract class B extends C<{a: 1}> { abstract f(): void; g(): Promise<{a: 1}> { x } }", "abstract class B extends C<{a: 1}> { abstract f(): void; g(): Promise<{a: 1}> S }"),
    ("switch (x) { case 1: { if (a) { b } break; } default: { f(() => { c }) } }", "switch (x) { case 1: { if (a) { b } break; } default: { f(() => S) } }"),
    ("class P {\n async q(a: string, b = { c: 1 }): Promise<void> {\n  await x;\n }\n}", "class P {\n async q(a: string, b = { c: 1 }): Promise<void> S\n}"),
    ("  \n ", ""),
    ("", ""),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_shapes(text, want):
    assert skeleton(text) == (text if want is None else want.replace("S", STUB))


class Program:
    """Random statements, each as (text, skeleton)."""

    def __init__(self, seed):
        self.r = random.Random(seed)

    def name(self):
        return self.r.choice(["a", "b1", "$c", "_d", "getter", "settle"])

    def noise(self):
        return self.r.choice(["'{'", '"}"', "`{`", "`${1}}`", "/[}]{/.source", "1 / 2", "[1, 2]", "'it\\'s }'", "{ k: 1 }.k", "f(2)"])

    def comment(self):
        return self.r.choice(["", "/* } => { */ ", "// () => {\n", "\n"])

    def body(self, depth, stub):
        """A body in braces, replaced or with what is inside it replaced."""
        text, skel = self.statements(depth - 1)
        return "{ " + text + " }", STUB if stub else "{ " + skel + " }"

    def arrow(self, depth):
        head = self.r.choice(["() => ", "async x => ", "(a: string, { b }): void => "])
        text, skel = self.body(depth, True)
        return head + text, head + skel

    def member(self, depth):
        kind = self.r.randrange(4)
        if kind == 3:
            text, skel = self.arrow(depth)
            return f"p = {text};", f"p = {skel};"
        head = [f"{self.name()}(x = {{ y: 1 }}) ", f"static async {self.name()}<T>(): Promise<{{ z: T }}> ", f"{self.r.choice(['get', 'set'])} {self.name()}() "][kind]
        text, skel = self.body(depth, kind < 2)
        return head + text, head + skel

    def statement(self, depth):
        kind = self.r.randrange(8 if depth else 2)
        if kind == 0:
            t = f"const {self.name()} = {self.noise()};"
            return t, t
        if kind == 1:
            t = f"return {self.noise()};" if depth < 2 else f"x = {self.noise()};"
            return t, t
        if kind == 2:
            head = f"function {self.name()}(a: {{ q: 1 }}, b = [1]) "
        elif kind == 3:
            head = f"if ({self.noise()}) "
        elif kind == 4:
            head = f"const {self.name()} = function () "
        elif kind == 5:
            members = [self.member(depth) for _ in range(self.r.randint(0, 3))]
            head = f"class K{self.r.choice(['', ' extends L'])} {{ "
            return head + " ".join(m[0] for m in members) + " }", head + " ".join(m[1] for m in members) + " }"
        elif kind == 6:
            text, skel = self.arrow(depth)
            head, tail = self.r.choice([("list.map(", ");"), ("const w = ", ";"), ("const t = `} ${", "} {`;"), ("const o = { k: ", ", m: 2 };")])
            return head + text + tail, head + skel + tail
        else:
            parts = [self.body(depth, True) for _ in range(2)]
            a, b = self.name(), self.name()
            return f"const o = {{ {a}() {parts[0][0]}, n: {{ async {b}() {parts[1][0]} }} }};", f"const o = {{ {a}() {parts[0][1]}, n: {{ async {b}() {parts[1][1]} }} }};"
        text, skel = self.body(depth, kind == 2)
        tail = ";" if kind == 4 else ""
        return head + text + tail, head + skel + tail

    def statements(self, depth):
        out = []
        for _ in range(self.r.randint(0 if depth < 3 else 1, 3)):
            c = self.comment()
            text, skel = self.statement(depth)
            out.append((c + text, c + skel))
        return "\n".join(t for t, _ in out), "\n".join(s for _, s in out)


@pytest.mark.parametrize("seed", range(300))
def test_generated_programs(seed):
    text, skel = Program(seed).statements(3)
    assert skeleton(text) == (skel if text.strip() else "")


@pytest.mark.parametrize("unit", ["{", "`${", "(", "() => { ", "/* ", "'", "class A { m() { ", "`", "a / b "])
def test_long_texts_take_linear_time(unit):
    began = time.perf_counter()
    skeleton(unit * 40_000)
    assert time.perf_counter() - began < 5
