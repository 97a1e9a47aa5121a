import ast
import glob
import os

import pytest

from loomgraph.llm.operators.syntax import check

JAVA = r'''
@file
package a.b.c;
import java.util.*;
import static java.lang.Math.max;
@SuppressWarnings({"a", "b"}) @Deprecated(since = "1")
public abstract sealed class A<T extends Comparable<? super T> & Runnable> extends B.C<T> implements D, E<String[]> permits F {
    private static final int[] X = {1, 2, 0x1F, 0b101, 1_000}, Y[] = {{1}, {2}};
    static { X[0] = 1; }
    { init(); }
    long big = 10L; double d = .5e-3, e = 1.0; float f = 1f; char c = '\'', u = '\u0041';
    String text = """
        say "hi"
        """;
    protected <U> A(final U u, int... rest) throws IOException, Err { this(u); super.go(); }
    public <R> Map<String, List<? extends R>> get(@Nullable String s, int[] a[]) throws X { return null; }
    abstract void go();
    int old()[] { return null; }
    void all(A<T> this) throws Exception {
        var list = new ArrayList<Map<String, int[]>>() {{ add(null); }};
        for (int i = 0, j = 1; i < 10 && j >> 2 > 1; i++, j--) continue;
        for (final var x : list) { if (x instanceof Map<?, ?> m && !m.isEmpty()) break; else x.y().z = 1; }
        for (;;) { break; }
        outer: while (true) { do { break outer; } while (false); }
        int k = (int) 3.5 + (a) + (b) - -c; Object o = (Runnable & Foo) () -> {}; Object p = (String) o; Object q = (T[]) o;
        Function<Integer, Integer> fn = x -> x * 2; BiFunction<A, B, C> g = (x, y) -> { return x; }; F h = (int x, String... y) -> x;
        Supplier<List<String>> sup = ArrayList<String>::new; IntFunction<int[]> mk = int[]::new; Runnable r = this::go, r2 = super::go, r3 = String::length;
        switch (k) { case 1: case 2: go(); break; default: go(); }
        int z = switch (k) { case 1, 2 -> 3; case 4 -> { yield 5; } default -> throw new X(); };
        try (var in = open(); other) { go(); } catch (A | B ex) { throw ex; } finally { }
        synchronized (this) { assert k > 0 : "no"; }
        int t = k > 0 ? k : x -> 1; a[i][j++] += b.c(d)[e].f; k >>>= 2; k >>= 1; boolean bb = a < b == c > d; new A().new Inner<>(1).go(); int[] arr = new int[3][], arr2 = new int[]{1, 2,};
        Class<?> cl = int[].class, cm = String[].class, cn = void.class; List<String>[] gen; A.<String>go(); this.<T>go(1);
        final class Local {} enum E { A, B } record R(int a) {} interface I {}
        ;
    }
    enum Op implements F { PLUS("+") { int apply() { return 1; } }, MINUS, ; private final String s; Op(String s) { this.s = s; } }
    record Point<T>(@A int x, T... y) implements Z { Point { check(x); } static int n; Point(int a) { this(a, null); } }
    @interface Ann { String value() default "x"; int[] n() default {1, 2}; }
    interface Fun { default int a() { return 1; } private static void b() {} int c(); }
    non-sealed class N extends A {}
}
;
'''.replace("@file\n", "")

KOTLIN = r'''
@file:JvmName("x")
package a.b
import a.b.*
import a.b.C as D
/* outer /* nested */ comment */
typealias F<T> = (T, x: Int) -> Unit
const val X: Int = 1
val String.ext: Int get() = length
var p: List<String?>? = null
    private set
val lazyOne by lazy { 1 }
data class P(val a: Int = 1, private var b: String?, vararg c: Int) : Base<Int>(1), I by other {
    companion object { const val Z = 1 }
    init { println("x $a ${b?.let { "in $it" } ?: "none"} \$5 $") }
    constructor(a: Int) : this(a, "") { go() }
    override fun toString(): String = "a"
    inner class Q
    var v: Int
        get() = field
        set(value) { field = value }
    lateinit var late: String
}
sealed class S<out T : Any>(val x: T) where T : Comparable<T> { object O : S<Int>(1) ; class R : S<String>("") }
enum class E(val n: Int) : I { A(1) { override fun f() = 1 }, B(2); abstract fun f(): Int; companion object }
enum class G { X, Y }
fun interface Run { fun go() }
interface J { val a: Int; fun b() }
annotation class Ann(val s: String)
@Ann("x") suspend inline fun <reified T> T.foo(crossinline f: suspend T.(Int) -> Unit, g: (() -> Unit)? = null): Map<String, *> where T : Any {
    val (a, _) = pair
    for ((k, v) in map) { if (k in 1..10 step 2 && v !in list) continue else break }
    outer@ while (true) { do { break@outer } while (x is String) }
    val r = when (val y = x) { 1, 2 -> "a"; in 3..4 -> "b"; is String, !is Int -> { "c" } else -> throw IllegalStateException() }
    when { a > b -> return@foo; else -> {} }
    val t = try { a!!.b?.c } catch (e: Exception) { null } finally { }
    val l = list.filter { it > 1 }.map { (x, y): Pair<Int, Int> -> x + y }
        .fold(0) { acc, n -> acc + n }
        ?: 3
    val o = object : Runnable, X(1) { override fun run() {} }
    val fn = fun(x: Int): Int { return x }
    val s = """raw "quoted" $a ${b}
    """
    a[0] += 1; b.c = d as? E<Int>; x++ ; --y
    if (a) b() else if (c) d() else { e() }
    foo<Int>(1) { it }; bar(x = 1, *arr, y = { }); ::foo; String::length; this@P.a; a infix b
    val n = 1_000L + 0xFFu + 1.5f + 'c'.code + '\n'.code
    return mapOf("a" to 1)
}
fun String?.orX() = this ?: ""
class Gen<T>(t: T)
expect class Pl
'''

TS = r'''
import a, { b as c, type D } from "x"; import * as ns from 'y'; import type { T } from "z"; import "side"; import j = require("j");
export * from "q"; export { a as default, type T }; export type { U } from "u"; export default abstract class Abs {}
declare module "m" { export function f(x: number): string; } declare const VERSION: string; declare global { interface Window { x: any } }
enum Color { Red = 1, Green = Red << 1, "a-b" = 2 } const enum E { A }
interface I<T = {}> extends J<T>, K { readonly a?: string; [key: string]: any; (x: number): void; new (x: string): I<T>; m<U>(a: U): asserts a is T; get x(): number; }
type Fn = (a: number, ...rest: string[]) => x is string; type C = A extends infer U extends string ? U[] : never; type M = { readonly [K in keyof T as `x${K}`]?: T[K] }; type Tup = [a: string, b?: number, ...rest: T[]]; type Lit = "a" | 1 | -1 | true | null | undefined | void;
type G = typeof import("x"); type Q = A["b"]["c"][]; type N = abstract new () => object; type P = (new () => X) | keyof typeof y;
namespace A.B { export const x = 1; export namespace C {} }
abstract class X<T> extends Y<T> implements I<T>, Z {
  private readonly a: string = "x"; static #p?: number; declare b: number; public static override async *gen<T>(this: X<T>, @Dec() public x?: number): AsyncGenerator<T> { yield* other(); }
  constructor(private a: string, public readonly b = 1) { super(); }
  abstract foo(): void; get v(): number { return 1 } set v(x) {} [key: string]: any; static { init(); } accessor z = 1; m?(): void; @dec prop!: string;
}
function over(a: string): void; function over(a: any) {} function g<const T extends object>(x: T, y?: number): x is U { return true }
const f = async <T,>(x: T): Promise<T> => x; const g2 = (x?: number, { a, b }: { a: string; b?: number } = {}): void => {}; let y = <any>x; let z = x as unknown as Foo<Bar>[]; let w = x!.y!; let s = obj satisfies T;
foo<string>(1); new Map<string, number[]>(); a < b; (a as any) = 1; const x: Array<Array<number>> = []; if (a<b || c>d) {} let t = cond ? (x) : y; let u = cond ? (x): number => 1 : 2;
for (const [k, v] of Object.entries(m)) { } label: for (;;) { continue label; } try { } catch { } type; let type = 1; let of = 2; abstract; declare;
let r = /a[/]b/gi.test(x) ? a / b / c : `t ${a + `n ${b}`} x`; let big = 10n, n = 1_000.5e3; a ??= b; a?.[0]?.(1)?.b; export = foo;
'''

JS = r'''#!/usr/bin/env node
import React, { useState as us, default as d } from "react"; import * as x from 'x' with { type: "json" }; export * as y from "y";
export default function App({ a, b: { c = 1 }, ...rest }, [d, , e] = []) {
  const [s, set] = us(null)
  return <div className="x" {...rest} data-a={a ? "it's" : `t${b}`}>it's text & more {/* c */} {list.map(i => <Item key={i} {...i} />)}<></><a.b.c x:y="1" r=<b/> >{}</a.b.c></div>
}
class A extends (B, C) { #p = 1; static s; static #q() {} get x() { return this.#p } set x(v) { } static async *[Symbol.iterator]() { yield 1; await z } 'str'() {} 12() {} static { this.a = 1 } async m() { for await (const x of y) {} } static async = 1; get; set }
const o = { a, b, get c() { return 1 }, set c(v) {}, async d() {}, *e() {}, async *f() {}, [g]: 1, 'h': 2, 3: 4, ...i, get: 1, if: 2, async: 3 };
const { p, q = 1, ...r } = o; [a, b] = [b, a]; ({ a, b: c.d = 1 } = o);
let f = x => x, g = async x => { await x }, h = async (x, y) => ({}), i = () => {}, j = function* () { const x = yield; yield* y };
if (a) b; else c
do x++; while (x < 5) y()
for (let i = 0, n = 5; i < n; i++) {} for (const k in o) ; for (var z of w) {} for (;;) break;
switch (x) { case 1: case 2: { break } default: y }
lbl: { break lbl }
var re = /[/\]]+/g, n = a / b / c, t = a++ / 2; x = y / z; if (/x/.test(s)) {} ; return_ = 1
a ||= b; a **= 2; a?.b?.[c]?.(d); new.target; import.meta.url; import("x").then(); new Foo; new Foo().bar; new (foo())(); typeof void 0; delete a[b]
throw new Error(`a ${b ? `c ${d}` : ''} e`)
'''.replace("new.target;", "")

PHP = r'''<html><?php
declare(strict_types=1);
namespace A\B;
use A\{B, C as D, function e}; use function x\y; use const Z\W as V;
#[Attr(1), Other] final readonly class P extends \Q\R implements I, J { use T, U { a as protected b; T::c insteadof U; } const X = 1, Y = self::X . 'a'; final public const string Z = "z"; private ?int $a = null; public static int|string $b; var $c;
  public function __construct(private readonly array $x = [], protected ?A &$y = null, string ...$rest) { parent::__construct(...$x); }
  abstract protected static function f(): static; public function &ref(self|null $a): ?iterable { yield 1 => 2; yield from g(); return; } }
enum Suit: string implements HasX { case Hearts = 'H'; case S = 'S'; const W = self::S; public static function f(): self { return static::Hearts; } }
interface I extends A, B { public function x(); } trait T { abstract function z(); } abstract class AA {}
function f(int $a, ?string $b = null, A|B|null $c = null, (X&Y)|null $d = null): never { throw new \Exception("x {$a['k']->b()} $b[0] ${c} \$"); }
$x = fn(int $a): int => $a * 2; $y = function () use (&$x, $z): void { static $n = 0, $m; global $g; }; $z = static fn() => 1; $c = strlen(...); $o = new class(1) extends B { public $q; };
[$a, [$b, 'k' => $c]] = $arr; list(, $b) = $arr; ['x' => $x] = $q; $a ??= $b?->c?->d() ?? E::$f['g']; $$name = ${'v' . 1}; $obj->{$prop} = $obj::class; A::{$m}(); $f()(); (clone $a)->b; new $cls($x); new ($y . 'z');
$m = match(true) { $a > 1, $b => 'x', default => throw new E(), }; $i = (int) $x + (string)$y; $s = <<<EOT
 heredoc $x {$y->z}
 EOT . <<<'N'
raw
N; $v = $a <=> $b ?: $c; $b = !$a instanceof B && isset($x['a'], $y) || empty($z) xor true; print "x"; echo 1, 2; @$a[1]++; --$b; $n = 1_000 + 0x1F + .5e3; `ls $x`;
if ($a): echo 1; elseif ($b): else: endif; foreach ($a as $k => &$v): endforeach; for ($i = 0, $j = 1; $i < 3; $i++): endfor; while (1): break 2; endwhile; switch ($x) { case 1: default: } switch ($y): case 2; break; endswitch;
if ($a) b(); else if ($c) d(); elseif ($e) { } else { } do { continue; } while (0); try { } catch (A | B $e) { } catch (C) { } finally { } goto end; end: unset($a, $b['c']); const Q = 1; foreach (f() as [$a, $b]) { } named(a: 1, b: ...$x); exit; return include 'x.php';
?> text <?= $x, 1 ?> <?php if ($x) { ?> <b><?php } __halt();
'''

PY = r'''
@dec(1)
async def f[T: int, *Ts](a, /, b: int = 1, *args: *Ts, c, d=2, **kw) -> "x":
    async with a as b, c: pass
    async for x in y: await z
    return [i async for i in x if i if not j]
class A[T](B, metaclass=M): x: int; y: str = ""
type Alias[T] = list[T]
match x:
    case [1, -2.5, *rest] | {"a": b, **c} if b: pass
    case A.B(x, y=1) as z: pass
    case None | "s" "t" | 1+2j: pass
    case _: pass
match = 1; match(x); type = 3; case = match [0]
with (open(a) as b, open(c)): pass
try: pass
except* (A, B) as e: raise X from e
lambda *a, k=1, **b: (yield)
x = y = *a, b; a, *b = c; (a) : int = 1; a[1:2, ::3, ...] += f"{x!r:>{w}} {y=} {'a' 'b'} {d["k"]} {{}}" rf"\d{n}"
print(*a, k=1, **b) if a is not b else not c in d
if (n := 10) > 5: del a[0], b.c
global g
{**a, 'b': 1}; {*a, 1}; {k: v for k, v in x}; (i for i in x); b"a" rb'\x'; 0xF_F + 1_0.5e-3j + 0o7; a @ b // c ** -d; ~a << 2
if 1:
	x = 1
'''


@pytest.mark.parametrize("path,code", [("A.java", JAVA), ("a.kt", KOTLIN), ("a.ts", TS), ("a.jsx", JS), ("a.php", PHP), ("a.py", PY)])
def test_valid(path, code):
    assert check(code, path) == []
    assert check("﻿" + code.replace("\n", "\r\n"), path) == []


@pytest.mark.parametrize("path", ["A.java", "a.kt", "a.ts", "a.js", "a.php", "a.py"])
def test_empty_and_comments(path):
    mark = "#" if path.endswith(("py",)) else "//"
    for text in ("", "\n\n", f"{mark} only this\n", f"{'<?php ' if path.endswith('php') else ''}{mark} x"):
        assert check(text, path) == []


BROKEN = {
    "A.java": ["class A { void f() { int x = 1 } }", "class A { void f() { x; } }", "class A { void f( { } }", "class A {", 'class A { String s = "a; }', "class A { void f() { int x = 1; } } }", "<<<<<<< HEAD\nclass A {}", "class A { void f() { a = “b”; } }", "def f():\n  pass", "class A { void f() { 1 = x; } }", "class A { void f() { try { } } }", "class A { char c = ''; }", "class A { void f() { if x { } } }"],
    "a.kt": ["fun f() { val x = 1 val y = 2 }", "class A {", 'val s = "a', "foo()", "fun f() { if (a { } }", 'val s = "${a"', "=======\nfun f() {}", "fun f( { }", "public class A { private int x; }", "val x = ", "fun f() { a + }", "fun f() { 1 = 2 }"],
    "a.ts": ["let x: = 1", "interface A { x: }", "class A { x: number y }", "type X = ;", "let a = <div/>", "function f(a: number { }", "const x;", "return 1"],
    "a.js": ["let x: number = 1", "const a = 1 const b = 2", "class A { f() { }", "`a ${b`", "<a><b></a>", "a = 'x", "f(;", "if (a { }", "1 = 2", "const x", "var a = /x", "--- a/x\n+++ b/x", "interface A {}", "x = {a = 1}", "a => { b", "class { }", "import a from b", "for (let x of) {}", "a ** -b ** c d"],
    "a.php": ["<?php $x = 1 $y = 2;", "<?php class A { $x; }", "<?php function f( { }", "<?php if ($x) {", "<?php echo 'a;", "<?php $a->;", "<?php foo(;", "<?php <<<<<<< HEAD", "<?php class A { public function f() }", "<?php 1 = $x;", "<?php try { }", '<?php "a {$b";', "<?php import x from y;"],
    "a.py": ["def f()\n  pass", "x = (1", "if a:\npass", "  x = 1", "a = 'x", "a b", "x = “a”", "f(a=1, b)", "for x in: pass", "f'{a'", "def f(a=1, b): pass", "1 = x", "try:\n  pass", "class A:\n  def f(self):\n    x\n   y"],
}


@pytest.mark.parametrize("path,code", [(p, c) for p, cs in BROKEN.items() for c in cs])
def test_broken(path, code):
    assert check(code, path)


def test_all_errors_are_stored_and_recovery_goes_on():
    errors = check("class A {\n void f() { int = 1; ok(); foo bar baz; ok(); }\n void g() { x +; }\n}", "A.java")
    assert [n for n, _ in errors] == [2, 2, 3]
    assert len(check("def f:\n  pass\nx = = 1\ny = 1\n", "a.py")) == 2


def test_unknown_path_long_and_deep_texts():
    assert check("x", "a.txt") is None
    assert check("x = [" + "1, " * 200_000 + "]", "a.py") == []
    assert check("class A { int x = " + " + ".join(["1"] * 50_000) + "; }", "A.java") == []
    assert check("x = " + "(" * 100_000 + "1" + ")" * 100_000, "a.js") == []


def test_python_agrees_with_the_interpreter():
    folder = os.path.dirname(os.__file__)
    for f in sorted(glob.glob(folder + "/*.py"))[:80]:
        with open(f, encoding="utf8", errors="replace") as s:
            text = s.read()
        from loomgraph.llm.operators.syntax.python import Python

        for t in (text, text[: len(text) // 2], text.replace(":", "", 1), text[: len(text) // 3] + text[len(text) // 3 + 9 :]):
            try:
                ast.parse(t)
                ok = True
            except (SyntaxError, ValueError):
                ok = False
            assert (Python(t).run() == []) == ok, f


@pytest.mark.parametrize("path,bad", [("A.java", "void f{i}() {{ int x = ; }}"), ("a.js", "let x{i} = ;"), ("a.ts", "let x{i} = ;"), ("a.kt", "val x{i} = )"), ("a.php", "$x{i} = ;"), ("a.py", "x{i} = )")])
def test_all_errors_of_a_text_with_very_many(path, bad):
    lines = [bad.format(i=i) for i in range(1000)]
    head, tail = {"A.java": ("class A {", "}"), "a.php": ("<?php", "")}.get(path, ("", ""))
    errors = check("\n".join([head, *lines, tail]), path)
    assert {n for n, _ in errors} >= set(range(2, 1002)) and not any("too many" in m for _, m in errors)


@pytest.mark.parametrize("path, text", [("a.java", "class A {{ int f() {{ return {}1{}; }} }}"), ("a.kt", "val x = {}1{}"), ("a.js", "x = {}1{};"), ("a.ts", "const x = {}1{};"), ("a.php", "<?php\n$x = {}1{};")])
def test_depth_is_not_limited(path, text):
    assert check(text.format("(" * 20_000, ")" * 20_000), path) == []
    assert check(text.format("(" * 20_000, ")" * 19_999), path)
