import random
import re

from billweave.functions import normalize, text
from billweave.sources import files
from pyspark.sql import functions as F


def test_dates(column):
    raw = ["2026年05月15日", "2026年5月15日", "2026/05/15", "2026-05-15", "20260515", "", "15-05-2026", " 2026.5.1 x", "2026 年 1 月 2"]
    assert column(normalize.date_text, raw) == [
        "2026-05-15", "2026-05-15", "2026-05-15", "2026-05-15", "2026-05-15", "", "15-05-2026", "2026-05-01", "2026-01-02"]


def test_amounts(column):
    raw = ["¥1,234.56", "￥800.00", "$500.00", "-500.00", "1234.56", "1000", "1，234.56", "€999.99", "", "1　2 3"]
    assert column(normalize.amount_text, raw) == [
        "1234.56", "800.00", "500.00", "-500.00", "1234.56", "1000", "1234.56", "999.99", "", "123"]


def test_check_codes_and_width(column):
    assert column(normalize.check_code_text, ["1234 5678 9012", "123456", "", "1　2"]) == ["123456789012", "123456", "", "12"]
    assert column(normalize.narrow, ["ＡＢＣ", "１２３", "ＡＢＣ１２３xyz", "plain", "", "ａｂ"]) == [
        "ABC", "123", "ABC123xyz", "plain", "", "ａｂ"]


def test_field_rule_switches(column):
    off = normalize.Options(normalize_date=False, normalize_amount=False)
    assert column(lambda c: normalize.field_text("invoice_date", c, off), ["２026/1/2"]) == ["2026/1/2"]
    assert column(lambda c: normalize.field_text("total_amount", c, off), ["¥1"]) == ["¥1"]
    assert column(lambda c: normalize.field_text("check_code", c, off), ["１ 2"]) == ["12"]


def test_numbers(column):
    got = column(normalize.number, ["", "1.5", "abc", "5d", " 2 ", "1e2", None])
    assert [None if g is None else float(g) for g in got] == [0.0, 1.5, None, None, 2.0, 100.0, 0.0]


def test_duration(column):
    assert column(normalize.duration_text, [0.0, 3725.9, 360000.0], "double") == ["00:00:00", "01:02:05", "100:00:00"]


def test_strip_as_python(column):
    values = ["\x1c a b　", " \t\nx\x85\xa0", "", "　", "a​b "]
    assert column(text.strip, values) == [v.strip() for v in values]


def test_leading_literal():
    assert text.leading_literal(r"税\s*额") == "税"
    assert text.leading_literal(r"ab*c") == "a"
    assert text.leading_literal(r"[x]") == ""
    assert text.leading_literal(r"（小写）[^¥]*") == "（小写）"


def test_literal_alternatives():
    assert text.literal_alternatives("(a|bc)") == ("a", "bc")
    assert text.literal_alternatives(r"(a|b+)") == () and text.literal_alternatives("a|b") == ()


def test_every_blank_is_one_for_both(column):
    import re

    blanks = [chr(c) for c in range(0x10000) if chr(c).isspace()]
    assert set(blanks) == set(text.BLANK_CHARS)
    assert column(lambda c: F.rlike(c, F.lit(text.jvm_regex(r"^\s$"))), blanks) == [True] * len(blanks)
    others = [chr(c) for c in range(1, 0xD800) if not chr(c).isspace()]
    assert column(lambda c: F.rlike(c, F.lit(text.jvm_regex(r"\s"))), ["".join(others)]) == [False]
    assert all(re.match(r"\s", b) for b in blanks)


def brute_merge(raw: str) -> str:
    """Line by line: trimmed lines, each label line may take one value line."""
    lines = [l.strip() for l in raw.split("\n") if l.strip()]
    out = []
    while lines:
        line = lines.pop(0)
        if line[-1] in "：:＝=，," and lines and len(lines[0]) > 1 and lines[0][0] not in "：:＝=":
            line += " " + lines.pop(0)
        out.append(line)
    return "\n".join(out)


def test_merge_label_lines(column):
    rng = random.Random(7)
    alphabet = ["a", "b", "：", ":", "=", "，", "\n", "\n", " ", "　", "\x1c", "票"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["发票号码：\n\n 123", "A：\n：x", "A：\nB：\nC", "A：\nx"]
    assert column(text.merge_label_lines, texts) == [brute_merge(t) for t in texts]


def test_extension_as_splitext(column):
    import os

    names = ["a.pdf", ".pdf", "..pdf", "a.b.OFD", "x", "a.", "...a.b", "发票.Jpg", "a b.png"]
    assert column(files.extension, names) == [os.path.splitext(n)[1].lower() for n in names]


def test_regex_translation_matches_python(column):
    rng = random.Random(3)
    pattern = r"发票代码[：:＝=\s]*([A-Z0-9]{6,20})"
    texts = ["发票代码" + "".join(rng.choice("：: \x1c　\nA1Ｂ9") for _ in range(rng.randrange(14))) for _ in range(500)]
    expected = [(m.group(1) if (m := re.search(pattern, t)) else "") for t in texts]
    assert column(lambda c: text.capture(c, pattern), texts) == expected


def test_long_blank_runs_stay_linear(column):
    long = "名称" + " " * 200_000 + "x"
    assert column(lambda c: F.char_length(text.merge_label_lines(c)), [long + "\n y"]) == [len(long) + 2]


def test_blank_class_is_the_set_that_strip_removes(spark):
    """Every code point: the class and its complement hold what the trimmed characters are."""
    from billweave.functions.text import BLANK_CHARS, BLANK_CLASS, INLINE_BLANK

    points = spark.range(1, 0x110000).where("id < 55296 OR id > 57343").select(
        "id", F.decode(F.lpad(F.unhex(F.hex("id")), 4, F.unhex(F.lit("00"))), "utf-32").alias("c")).where("c <> ''")

    def held(pattern):
        return {r.id for r in points.where(F.rlike("c", F.lit(f"(?Ud)^{pattern}$"))).select("id").collect()}

    blank = {ord(c) for c in BLANK_CHARS}
    assert held(f"[{BLANK_CLASS}]") == blank and held(INLINE_BLANK) == blank - {10}
    assert points.where(~F.rlike("c", F.lit(f"(?Ud)[^{BLANK_CLASS}]"))).count() == len(blank)


def test_width_of_plain_text_is_left_alone(column):
    from billweave.functions.normalize import narrow

    assert column(narrow, ["ABC 019", "Ａｂ９号", "", None]) == ["ABC 019", "Aｂ9号", "", None]
