"""Declarations in C# files made by hand."""

from __future__ import annotations

from sparkloom.functions.declarations import declarations, declared_lines

FILE = '''using System;
#if DEBUG
namespace A.B
{
    [Serializable]
    public sealed partial class Cat<T>
        : Animal<T>, IDisposable
        where T : class, new()
    {
        private readonly Dictionary<string, List<int>> _map = new() { ["a{"] = F("}") };
        private Func<int, int> f = x => { return G(x); };
        public int Age { get; set; } = Compute(1);
        public int this[int i] => Get(i);
        public event EventHandler Changed;
        delegate void D(int x);
        enum E { One = 1, Two }

        public Cat(
            string name) : base(name)
        {
            Local(1);
            int Local(int x) { return x; }
        }

        [Obsolete("use } instead"), Other(typeof(List<int>))]
        public async Task<Dictionary<string,
            List<int>>> LoadAsync<U>(
            [From("x")] U value,
            (int a, string b) pair = default)
            where U : struct
        {
            var s = $"{{ {Name("}")} {value:N2} \\"";
            var v = @"c:\\"" }";
            var r = """ } " } """;
            char c = '}';
            // }
            if (s == v) { Call(); }
        }

        (int x, string y) Pair() => (1, "a");
        int[]? Rows(int n) => null;
        public static bool operator ==(Cat<T> a, Cat<T> b) => true;
        public static implicit operator
            int(Cat<T> c) => 1;
        void IDisposable.Dispose() { }
        ~Cat() { }
        static Cat() { }
        public abstract void Walk(int x);

        private record struct Point(int X, int Y);
        interface IInner { void Do(); int P { get; } }
    }
}
public record Person(string Name);
public readonly ref struct Span { }
'''


def test_members_of_a_file():
    lines = FILE.split("\n")
    found = declared_lines(FILE)
    assert all(lines[k] == v for k, v in found.items())
    want = """public sealed partial class Cat<T>|public Cat(|public async Task<Dictionary<string,|(int x, string y) Pair() => (1, "a");|int[]? Rows(int n) => null;|public static bool operator ==(Cat<T> a, Cat<T> b) => true;|public static implicit operator|void IDisposable.Dispose() { }|static Cat() { }|public abstract void Walk(int x);|private record struct Point(int X, int Y);|interface IInner { void Do(); int P { get; } }|public record Person(string Name);|public readonly ref struct Span { }"""
    assert [v.strip() for _, v in sorted(found.items())] == want.split("|")


def test_statements_are_none():
    assert declared_lines("Console.WriteLine(1);\nint Add(int a) { return a; }\nif (x) { Foo(1); }\n") == {}
    assert declared_lines(None) == declared_lines("") == {}
    assert declared_lines("namespace N;\nclass A { int x = F(1); A() { } B b = new B(2); }") == {1: "class A { int x = F(1); A() { } B b = new B(2); }"}
    assert declared_lines("class A\r\n{\r\n  void F()\r\n  {\r\n") == {0: "class A", 2: "  void F()"}


def test_broken_sources_end():
    for text in ("class A { void F( {", 'class A { string s = "abc', "}}}} class B { }", 'class A { string s = $"{x', "/* class A", "class A { @", '"""'):
        declared_lines(text)


def test_column(spark):
    rows = spark.createDataFrame([(1, "class A\n{\n  int F(\n int x) => 1;\n}"), (2, None)], "id int, s string")
    got = {r["id"]: [tuple(x) for x in r["d"]] for r in rows.select("id", declarations(rows["s"]).alias("d")).collect()}
    assert got == {1: [(0, "class A"), (2, "  int F(")], 2: []}
