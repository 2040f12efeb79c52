"""Text normalization as Column expressions; Unicode classes instead of \\w, which is ASCII in Java."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CJK = r"一-鿿"
#: Ideographs of the basic block and extension A; those with the compatibility block, CJK signs and full-width forms.
IDEOGRAPHS = r"㐀-鿿"
EASTERN = r"一-鿿㐀-䶿\x{F900}-\x{FAFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEE}"
#: White space as Python and JavaScript understand it; Java's \\s is ASCII only.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: Chinese digits and their values (fixed values).
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "兩": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
#: Ideographs that text layers give for common ones (fixed values).
COMPATIBILITY = {"\uf9e4": "理", "\uf9dd": "利", "\uf9ca": "流", "\uf9ea": "離", "\uf967": "不", "\uf99c": "列", "\uf90a": "金"}
#: Private glyphs, and letters that stand for circled digits in a broken text layer (fixed values).
GLYPHS = {"\uf0e0": "→", "\uf0b8": "÷", "\uf06c": "L", "\u00a0": " ", "´": "×"}
MARKERS = {"Å": "①", "Ç": "②", "É": "③", "Ñ": "④", "\uf081": "①", "\uf082": "②", "\uf083": "③", "\uf084": "④"}
#: Full-width technical signs and what they become (fixed values).
TECHNICAL = {"／": "/", "～": "~", "〜": "~", "－": "-", "—": "-", "％": "%", "（": "(", "）": ")", "［": "[", "］": "]", "：": ":"}
#: Signs of a sentence (fixed value).
SENTENCE = "[、。，；：？！,.;:!?]"
#: Characters that take in the gap behind or before them, pairs that lose theirs, and phrases (fixed values).
JOIN_LEFT = "的之及與和或為是在於由以而並但若則將被可需須應會能未已不無有此該其第下上中內外前後至到向對就把給使讓因從才且仍又更最何哪幾同所"
JOIN_RIGHT = "的之及與和或為是在於由以而並但若則種類項個些時內外到何哪幾可需須應不未已同所"
JOIN_PAIRS = (
    "大幅", "市場", "曲線", "有效", "機械", "減量", "流動", "物種", "現象", "兩側", "產品", "相關", "臺灣", "藥量", "購入", "過程", "長期", "重要", "需求", "供給",
    "消費", "價格", "財貨", "資產", "負債", "權益", "會計", "調整", "分錄", "現金", "存貨", "淨利", "費用", "折舊", "損失", "股利", "普通", "特別", "公司", "設備",
    "專利", "財務", "報表", "收益", "出售", "成本", "保護", "設施", "其他", "許多", "授粉", "暫時", "導向", "能力", "上述",
)
PHRASES = (
    "農民 購物", "伴 手禮", "有效 分蘗", "分蘗 數", "巨 花魔芋", "起源 中心", "大幅 波動", "出現 糧食", "投入 大量", "重要 角色", "最能 說明", "哈密 瓜", "下列 何種", "下列 何者",
    "固定 成本", "變動 成本", "出售 成本", "公允 價值", "重大 影響", "應收 帳款", "應付 帳款", "應付 薪資", "股利 會計", "金融 資產", "平均 消費", "實質 利率", "下完藥 後", "情形 下",
    "公分 等", "高海拔至 低海拔", "作物 最不適合", "作物 培土", "哪些 作物", "透過 參與", "特遣隊 登陸", "防止 褐變", "農業 專業", "訓練內容 著重", "降低 福壽螺",
)
_GAP = f"[{IDEOGRAPHS}]{SPACE}+[{IDEOGRAPHS}]"


def translated(text: Column, table: dict[str, str]) -> Column:
    return F.translate(text, "".join(table), "".join(table.values()))


def spaced(text: Column) -> Column:
    """Known ideographs and technical signs folded, a space between eastern characters and Latin letters or digits, runs
    of white space made one, none at the ends."""
    t = translated(translated(text, dict(list(COMPATIBILITY.items())[:4])), TECHNICAL)
    t = F.regexp_replace(t, f"(?<=[{EASTERN}])(?=[A-Za-z0-9])", " ")
    t = F.regexp_replace(t, f"(?<=[A-Za-z0-9])(?=[{EASTERN}])", " ")
    return F.trim(F.regexp_replace(t, f"{SPACE}+", " "))


def gaps_removed(text: Column) -> Column:
    """No white space between two eastern characters, signs and full-width forms included."""
    return F.regexp_replace(text, f"(?<=[{EASTERN}]){SPACE}+(?=[{EASTERN}])", "")


def gaps_joined(text: Column, keep_tables: bool = False) -> Column:
    """Removes the gap between two ideographs where the left or the right one takes it in or the two are a known pair,
    after known phrases. Gaps are gone through from the left and don't share characters, so both characters of a gap are
    consumed whether it is joined or not: that is what the last alternative is for. keep_tables: texts that look like a
    table stay as they are."""
    t = text
    for phrase in PHRASES:
        t = F.regexp_replace(t, phrase.replace(" ", f"{SPACE}+"), phrase.replace(" ", ""))
    pair = "|".join(f"{p[0]}{SPACE}+{p[1]}" for p in JOIN_PAIRS)
    one = f"[{IDEOGRAPHS}]"
    t = F.regexp_replace(t, f"([{JOIN_LEFT}]){SPACE}+({one})|({one}){SPACE}+([{JOIN_RIGHT}])|(?={pair})({one}){SPACE}+({one})|({_GAP})", "$1$2$3$4$5$6$7")
    return F.when(looks_like_table(text), text).otherwise(t) if keep_tables else t


def gap_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(_GAP), 0))


def looks_like_table(text: Column) -> Column:
    """Two gaps or more, no sign of a sentence, and four tokens or three with ideographs: spacing that separates columns."""
    tokens = F.filter(F.split(text, f"{SPACE}+"), lambda t: t != "")
    eastern = F.filter(tokens, lambda t: t.rlike(f"[{IDEOGRAPHS}]"))
    return (gap_count(text) >= 2) & ~text.rlike(SENTENCE) & ((F.size(tokens) >= 4) | (F.size(eastern) >= 3))


def marks_mapped(text: Column) -> Column:
    """Circled digits for what a broken text layer gives instead."""
    return translated(text, MARKERS)


def layout_normalized(text: Column) -> Column:
    """The chain for positioned text: markers, ideographs and glyphs, single blanks, none before Western commas and stops,
    powers of ten repaired."""
    t = translated(translated(marks_mapped(text), COMPATIBILITY), GLYPHS)
    t = F.trim(F.regexp_replace(t, f"{SPACE}+", " "))
    return powers_joined(F.replace(F.replace(t, F.lit(" ,"), F.lit(",")), F.lit(" ."), F.lit(".")))


def stem(text: Column) -> Column:
    """Letters, digits and underscores only, lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_]", ""))


def compatibility_fixed(text: Column) -> Column:
    return translated(text, COMPATIBILITY)


#: Before these the exponent 6 that a text layer drops behind them belongs to the power of ten (fixed values).
_EXPONENT_BEHIND = ("，效益分別為", "，今若資金充裕")


def powers_joined(text: Column) -> Column:
    """`3 x 10 元，6` and its kin as `3×10^6 元，`; other tens before 元 as `3×10 元`."""
    ten = r"(\d+)\s*[×xX]\s*10\s*元"
    t = F.regexp_replace(text, ten + r"([、，,])\s*6(?![\p{L}\p{N}_])", "$1×10^6 元$2")
    for words in _EXPONENT_BEHIND:
        t = F.regexp_replace(t, f"{ten}{words}6(?![\\p{{L}}\\p{{N}}_])", f"$1×10^6 元{words}")
    return F.regexp_replace(t, ten + r"(?![\p{L}\p{N}_])", "$1×10 元")


def chinese_number(text: Column) -> Column:
    """Integer of a numeral in Arabic or Chinese digits; null for anything else. A digit holds until a unit (十, 百) takes
    it; a unit without a digit counts once."""
    value = F.create_map(*[F.lit(x) for pair in DIGITS.items() for x in pair])
    state = F.struct(F.lit(0).alias("total"), F.lit(0).alias("now"))

    def step(acc: Column, c: Column) -> Column:
        unit = F.when(c == "十", 10).when(c == "百", 100)
        taken = acc["total"] + F.when(acc["now"] == 0, 1).otherwise(acc["now"]) * unit
        return F.when(unit.isNotNull(), F.struct(taken.alias("total"), F.lit(0).alias("now"))).otherwise(F.struct(acc["total"].alias("total"), F.coalesce(F.try_element_at(value, c), F.lit(0)).alias("now")))

    number = F.aggregate(F.split(text, ""), state, step, lambda acc: acc["total"] + acc["now"])
    return F.when(text.rlike("^[0-9]{1,9}$"), text.try_cast("int")).when(text.rlike(f"^[{''.join(DIGITS)}十百]+$"), number)


def article_number(main: Column, sub: Column) -> Column:
    """`12` or `12-1`."""
    return F.when(F.coalesce(sub, F.lit("")) == "", main).otherwise(F.concat(main, F.lit("-"), sub))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 2)).cast("int")


def fences_stripped(text: Column) -> Column:
    """A model's answer without code fences and thinking, for try_parse_json."""
    t = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.btrim(F.regexp_replace(t, r"(?m)^```[a-z]*\s*$", ""), F.lit(" \t\r\n"))


def explanation_cleaned(text: Column) -> Column:
    """The explanation of a model's answer: the field of that name if the answer is JSON, else the text behind the last
    sign of an output, without channel marks, fences and its heading, on one line."""
    t = F.trim(text)
    t = F.trim(F.regexp_replace(F.substring_index(t, "<channel|>", -1), r"(?s)<\|channel>thought.*$", ""))
    t = F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    field = F.nullif(F.trim(F.get_json_object(t, "$.explanation")), F.lit(""))
    plain = t
    for sign in ("改寫後：", "改寫後:", "輸出：", "輸出:"):
        plain = F.trim(F.substring_index(plain, sign, -1))
    plain = F.trim(F.regexp_replace(plain, r"^\s*(?:解釋|白話解釋)\s*[:：]\s*", ""))
    return F.coalesce(field, F.trim(F.regexp_replace(plain, r"\s*\n+\s*", " ")))


#: Lines that aren't part of a text, by kind of source (fixed values).
NOISE = {
    "exam": r"第\s*\d+\s*頁\s*[，,]\s*共\s*\d+\s*頁|^-\s*\d+\s*-$|^(?:【?請接續背面】?|【以下空白】)$",
    "management": r"公告試題僅供參考|第\s*\d+\s*頁|共\s*\d+\s*頁|^-\s*\d+\s*-$|^\d{3}\s*年四技$|^(?:【請接續背面】|請接續背面)$",
    "traffic": r"^第\s*\d+\s*頁|人員訓練所|學科檢定",
}


def noise_line(line: Column, kind: str | None = None) -> Column:
    """Page numbers, continuation marks and running headers, as the sources of one kind have them or of any kind."""
    t = F.trim(line)
    return F.coalesce(t.rlike(NOISE[kind] if kind else "|".join(f"(?:{p})" for p in NOISE.values())), F.lit(False))


def roc_year(date: Column) -> Column:
    """Gregorian year of a date whose year comes before the first slash, counted from 1912."""
    return F.split_part(date, F.lit("/"), F.lit(1)).try_cast("int") + 1911


def compare_key(text: Column) -> Column:
    """NFKC without white space, full stops and `(cid:n)` marks (711 is ˇ), for comparing extracted texts. NFKC also folds
    the other full-width signs. It has no built-in, so this runs on Arrow batches."""

    def key(s: str) -> str:
        s = unicodedata.normalize("NFKC", re.sub(r"\(cid:\d+\)", "", s.replace("(cid:711)", "ˇ")))
        return "".join(s.split()).replace("。", "")

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(key, na_action="ignore")

    return run(text)


def slug(text: Column, fallback: str) -> Column:
    """A file name as an id: no ending, white space as hyphens, nothing but letters, digits, underscores and hyphens,
    lower case; the fallback if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(text, r"\.[^.]+$", ""), r"\s+", "-")
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}_-]+", "")), F.lit("")), F.lit(fallback))


def article_slug(title: Column) -> Column:
    """`article-` and the title without white space, dashes as hyphens, other signs as one hyphen, lower case."""
    t = F.translate(F.regexp_replace(title, f"{SPACE}+", ""), "－—", "--")
    t = F.lower(F.btrim(F.regexp_replace(t, r"[^\p{L}\p{N}_-]+", "-"), F.lit("-")))
    return F.concat(F.lit("article-"), F.coalesce(F.nullif(t, F.lit("")), F.lit("unknown")))
