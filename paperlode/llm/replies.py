"""Problem 5: defective pairs of a question and a model's reply.

Every reply is taken apart once (frame, answer, reasons). The openings of the replies, with what they repeat of
their own question masked, are put into classes by MinHash with verified similarity. A class whose replies give no
answer and that recurs across unrelated questions is a template of refusal. Checks of copying, of language and of
how the reply ends label the other defects.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperlode.llm.lookalike import LOOKALIKES
from paperlode.llm.patterns import rx
from paperlode.session import cut_lineage

SIMILAR, SHINGLE, BANDS, ROWS, OPENING = 0.8, 5, 16, 4, 40
#: Texts of a bucket that all its texts are compared with; what they leave apart is joined by rare shingles, whatever its size.
LEADERS = 4
#: Language profiles are fitted on at most about so many documents, taken by a hash of their id, and so many characters of each.
PROFILE_DOCS, PROFILE_CHARS = 6_000, 4_000
#: A class is a template of refusal from so many questions on, with at most this share of answered replies.
MIN_PROMPTS, MOST_ANSWERED = 2, 0.05
#: Words of hollow frames, in lower case.
FRAME = {"null", "none", "na", "n", "a", "json", "answer", "reason", "judgements", "judgments", "confidence", "e", "答案", "答案为", "回答", "ответ", "undefined", "nan"}
#: How a question asks for the language of the reasons.
ASKED = {"zh": r"reasons in chinese|用中文|in chinese", "en": r"用英文|reasons in english|in english|用英语"}
_FOLD = str.maketrans(LOOKALIKES)
_BETWEEN = re.compile(r"[\W_]+")
_FOLDED = regex.compile(f"[{regex.escape(''.join(LOOKALIKES))}]")
_ANSWER = regex.compile(r"(?<![A-Za-z&./])(?:[A-D](?:\s*[,、，和&]\s*)?){1,4}(?![A-Za-z&])")
_ECHO = regex.compile(r"[“\"「『](.+?)[”\"」』]", regex.S)
_FENCE = regex.compile(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$")
#: Scripts by the code points at which they begin, for telling what a text is written in.
_SCRIPTS = [(0, ""), (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xC0, "latin"), (0x250, ""), (0x400, "ru"), (0x530, ""), (0x600, "ar"), (0x700, ""), (0x900, "hi"), (0x980, ""), (0xE00, "th"), (0xE80, ""), (0x1100, "ko"), (0x1200, ""), (0x1E00, "latin"), (0x1F00, ""), (0x3041, "kana"), (0x3100, ""), (0x3400, "zh"), (0xA000, ""), (0xAC00, "ko"), (0xD7B0, ""), (0xF900, "zh"), (0xFB00, ""), (0x20000, "zh"), (0x40000, "")]
_STARTS = np.array([at for at, _ in _SCRIPTS], dtype=np.uint32)
_KINDS = sorted({name for _, name in _SCRIPTS})
_KIND = np.array([_KINDS.index(name) for _, name in _SCRIPTS])
#: How many letters of a script say as much as one Han character.
_LETTERS = {"zh": 1, "kana": 1, "ko": 1, "ru": 3, "ar": 2, "hi": 2, "th": 2, "latin": 4}
#: Three-letter names of languages whose short name does not begin alike, by their short name.
_NAMES = {"ger": "de", "deu": "de", "spa": "es", "chi": "zh", "cmn": "zh", "zho": "zh", "jpn": "ja", "swe": "sv", "por": "pt", "dut": "nl", "nld": "nl", "pol": "pl"}
#: Beginnings of the names for no language, several languages and undetermined ones.
UNDETERMINED = ("un", "mu", "zx", "mi", "")
#: Log likelihoods must differ by so much before a Latin text counts as of one language.
MARGIN = 3.0


class Profiles:
    """Letter 3-gram statistics of the languages that are written in Latin letters."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.names = sorted(counts)
        grams = {g: k for k, g in enumerate(sorted({g for c in counts.values() for g in c}))}
        table = np.full((len(grams) + 1, len(self.names)), 0.5)
        for j, name in enumerate(self.names):
            for g, n in counts[name].items():
                table[grams[g], j] += n
        self.known: dict[str, np.ndarray] = {}
        self.grams, self.logs = grams, np.log(table / table.sum(axis=0)) if self.names else table

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}}

    def scores(self, text: str) -> np.ndarray | None:
        """Log likelihoods of a text, word by word; those of words are kept, as they recur."""
        words = rx(r"\p{Latin}+").findall(text.lower()) if self.names else []
        for word in words:
            if word not in self.known:
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[word] = self.logs[[self.grams.get(g, -1) for g in grams_of(word)]].sum(axis=0)
        return sum(self.known[w] if w in self.known else self.logs[[self.grams.get(g, -1) for g in grams_of(w)]].sum(axis=0) for w in words) if words else None

    def language(self, text: str) -> str:
        """The likeliest language, or `latin` where none is told or two are too near."""
        score = self.scores(text)
        if score is None:
            return "latin"
        best = int(score.argmax())
        others = np.delete(score, best)
        return self.names[best] if not len(others) or score[best] - others.max() >= MARGIN else "latin"

    def speaks_against(self, text: str, want: str) -> bool:
        """Whether another profile fits clearly better than that of a language, whichever it is: a language without a
        profile is told from the wanted one by its neighbour that has one."""
        score = self.scores(text)
        return score is not None and want in self.names and score.max() - score[self.names.index(want)] >= MARGIN


def grams_of(text: str) -> list[str]:
    out = []
    for word in rx(r"\p{Latin}+").findall(text.lower()):
        padded = f" {word} "
        out += [padded[i : i + 3] for i in range(len(padded) - 2)]
    return out


def language_name(name: str) -> str:
    """The short name of a language, however it is spelt: en for EN, en-GB and eng."""
    short = regex.split(r"[-_]", name.strip().lower())[0]
    return _NAMES.get(short, short[:2])


def profiles(documents: DataFrame | None, most: int = PROFILE_DOCS) -> Profiles:
    """Profiles of the languages that documents (doc_id, lang, text) name, fitted on a bounded sample of them. Wrong
    names are few and drown. Without documents Latin languages are not told apart."""
    if documents is None:
        return Profiles({})
    rows = documents.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", F.substring("text", 1, PROFILE_CHARS).alias("text"))
    n = rows.count()
    if n > most:
        rows = rows.filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) < int(most / n * 2**63))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, str], int] = {}
        for part in parts:
            for lang, text in zip(part["lang"], part["text"]):
                name = language_name(lang)
                written = "" if script_of(text) == "latin" else "other"
                sums[name, written] = sums.get((name, written), 0) + 1
                if not written:
                    for g in grams_of(unmixed(unicodedata.normalize("NFKC", text))):
                        sums[name, g] = sums.get((name, g), 0) + 1
        yield pd.DataFrame([(name, g, n) for (name, g), n in sums.items()], columns=["lang", "gram", "n"])

    sums = rows.mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    counts: dict[str, dict[str, int]] = {}
    for lang, gram, n in sums:
        counts.setdefault(lang, {})[gram] = n
    # how many texts of a name are in Latin letters, and how many are not; a name that stands mostly on others, or for
    # no language in particular, has no profile
    texts = {lang: (c.pop("", 0), c.pop("other", 0)) for lang, c in counts.items()}
    return Profiles({lang: c for lang, c in counts.items() if lang not in UNDETERMINED and texts[lang][0] > texts[lang][1]})


def narrow(text: str) -> str:
    """A text in narrow and composed forms."""
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def latin_look(text: str) -> str:
    """Letters of other scripts that print as Latin ones, as these; most texts have none."""
    return text if text.isascii() or not _FOLDED.search(text) else text.translate(_FOLD)


def fold(text: str) -> str:
    """Letters and digits only, in one case, width and look."""
    return _BETWEEN.sub("", latin_look(narrow(text)).casefold())


def shown(text: str) -> str:
    """A text without invisible characters."""
    return text if text.isascii() else rx(r"\p{Cf}+").sub("", text)


def visible(text: str) -> str:
    return shown(text).strip()


def unmixed(text: str) -> str:
    """Words that mix Latin letters with look-alikes of other scripts, in Latin letters."""
    if text.isascii() or not rx(r"[\p{Cyrillic}\p{Greek}]").search(text):
        return text
    return rx(r"\b(?=\w*\p{Latin})(?=\w*[\p{Cyrillic}\p{Greek}])\w+").sub(lambda m: m[0].translate(_FOLD), text)


def script_of(text: str) -> str:
    """The script most of a text is written in; empty where fewer than three characters' worth tell."""
    if text.isascii():
        return "latin" if sum(map(str.isalpha, text)) >= _LETTERS["latin"] else ""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    sums = np.bincount(_KIND[np.searchsorted(_STARTS, points, "right") - 1], minlength=len(_KINDS))
    counts = {name: sums[k] / _LETTERS[name] for k, name in enumerate(_KINDS) if name}
    if counts["kana"] >= 3 and counts["kana"] * 5 >= counts["zh"]:
        return "ja"
    best = max(counts, key=counts.get)
    return best if counts[best] >= (1 if best == "latin" else 3) else ""


def bare(text: str) -> str:
    """A text without invisible characters, quotations and titles, words of mixed scripts in Latin letters."""
    text = narrow(shown(text))
    return unmixed(rx(r"[“「『«\"][^”」』»\"]{0,80}[”」』»\"]|《[^》]*》").sub(" ", text))


def language(text: str, known: Profiles) -> str:
    """The language of a text by its script, among Latin ones by their profiles; empty where nothing tells."""
    text = bare(text)
    script = script_of(text)
    return known.language(text) if script == "latin" else "zh" if script == "kana" else script


def foreign(text: str, want: str, known: Profiles) -> bool:
    """Whether a text is in another language than the wanted one; false where nothing tells."""
    text = bare(text)
    script = script_of(text)
    if not want or not script:
        return False
    if script != "latin":
        return want != ("zh" if script == "kana" else script)
    return known.speaks_against(text, want) if want == "latin" or want in known.names else want in ("zh", "ja", "ko", "ru", "ar", "hi", "th")


def leaves(value: object) -> list[str]:
    """What a JSON value says: its strings, and booleans as words; numbers alone say nothing."""
    if isinstance(value, dict):
        return [x for v in value.values() for x in leaves(v)]
    if isinstance(value, list):
        return [x for v in value for x in leaves(v)]
    return [value] if isinstance(value, str) and visible(value) else ["true"] if isinstance(value, bool) else []


def reasons_in(value: dict) -> str:
    said = [v for k, v in value.items() if k not in ("answer", "e", "evidence_ids") and isinstance(v, str)]
    said += [str(x.get("reason", "")) for v in value.values() if isinstance(v, dict) for x in v.values() if isinstance(x, dict)]
    return " ".join(said)


def taken_apart(raw: str | None, question: str | None, options: list[str]) -> dict:
    """shape (empty, truncated, copy, plain), answered, reasons and opening of one reply."""
    asked = fold(question or "")
    out = {"shape": "plain", "answered": False, "reasons": "", "opening": "", "asked": asked}
    text = _FENCE.sub("", visible(raw or "")).strip()
    try:
        if text[:1].isalpha() and text not in ("null", "true", "false"):
            raise ValueError  # prose
        value = json.loads(text)
        if not leaves(value):
            return out | {"shape": "empty"}
    except ValueError:
        value = None
        if all(m[0] in FRAME for m in rx(r"\p{L}+").finditer(text.lower())) and not rx(r"\p{N}").search(text) and not _ANSWER.search(text):
            return out | {"shape": "empty"}
    folded = fold(" ".join(leaves(value)) if isinstance(value, (dict, list)) else text)
    at = folded.find(asked) if len(asked) >= 8 else -1
    if at >= 0:
        rest = folded[:at] + folded[at + len(asked) :]
        for option in options:
            rest = rest.replace(fold(option), "", 1) if fold(option) else rest
        if len(rest) <= 8 and not rx(r"答案|answer|故选|hence").search(rest):
            return out | {"shape": "copy"}
        for m in _ECHO.finditer(text):
            if value is None and fold(m[1]) == asked:
                text = (text[: m.start()] + " " + text[m.end() :]).strip()
                text = rx(r"^[^{\p{Po}]{0,20}[:：]\s*").sub("", text, count=1).strip()
                break
    start = text.find("{")
    if value is None and start >= 0 and not _ANSWER.search(text[:start]):
        body = text[start:]
        try:
            value, _ = json.JSONDecoder().raw_decode(body)
        except ValueError:
            if not body.rstrip().endswith("}"):
                return out | {"shape": "truncated"}
            given = rx(r"[\"']answer[\"']\s*:\s*[\"']([A-D]{1,4})").search(body)
            said = rx(r"[\"']reason[\"']\s*:\s*[\"'](.*?)[\"']\s*[,}]", regex.S).search(body)
            value = {"answer": given[1] if given else "", "reason": said[1] if said else ""}
    if isinstance(value, dict):
        if not leaves(value):
            return out | {"shape": "empty"}
        out["answered"] = bool(_ANSWER.search(" ".join(leaves({k: v for k, v in value.items() if k.lower() in ("answer", "choice", "value")}))))
        out["reasons"] = reasons_in(value)
        out["opening"] = out["reasons"]
        return out
    tail = rx(r"(?<![A-Za-z&.])[A-D](?:\s*[,、，]?\s*[A-D]){0,3}\s*$").search(text)
    given = _ANSWER.search(text[:30]) or tail or rx(r"(?:答案|故选|选|answer|hence|ответ|итак|よって|回答)\W{0,3}(?:is|为|是)?\W{0,3}[A-D]{1,4}", regex.I).search(text)
    ended = bool(rx(r"[。.!?！？．｡…][”」』\"’)）】]*$").search(text)) and not rx(r"[“「『(（][^”」』)）]{0,60}$").search(text)
    out["answered"] = given is not None
    said = rx(r"^\W*(?:答案|回答|answer|ответ|解答)\W{0,3}(?:为|是|is)?\W{0,3}[A-D]{1,4}\W*", regex.I).sub("", text)
    out["reasons"] = rx(r"(?:故选|选|hence|итак|よって)\W*[A-D]{1,4}\W*$", regex.I).sub("", said)
    out["opening"] = out["reasons"]
    if not ended and tail is None and not rx(r"[A-D]{1,4}").fullmatch(text):
        out["shape"] = "truncated"
    return out


def masked(opening: str, question: str | None) -> str:
    """The first words of an opening; numbers, and what also stands in its question, give way to one sign."""
    ask = narrow(question or "").lower()
    words = rx(r"\p{Han}|[\p{Hiragana}\p{Katakana}]|\d[\d.,]*|[\p{L}\p{N}]+").findall(narrow(opening).lower()[: 12 * OPENING])[:OPENING]
    asked = set(rx(r"[\p{L}\p{N}]+").findall(ask)) if any(len(w) >= 4 for w in words) else ()
    hide = [w[0].isdigit() or (len(w) >= 4 and w in asked) for w in words]
    for i, (w, after) in enumerate(zip(words, words[1:])):
        if (w + after if "㐀" <= w <= "鿿" else w + " " + after) in ask:
            hide[i] = hide[i + 1] = True
    kept = ["#" if h else w for w, h in zip(words, hide)]
    return " ".join(w for i, w in enumerate(kept) if w != "#" or i == 0 or kept[i - 1] != "#")


def expected_language(question: str | None, known: Profiles) -> str:
    plain = rx(r"\s+").sub(" ", latin_look(shown(narrow(question or ""))).lower())
    for name, how in ASKED.items():
        if rx(how).search(plain):
            return name
    return language(question or "", known)


def words_of(question: str | None) -> str:
    """The words and Han characters of a question, in one case, width and look."""
    return " ".join(rx(r"\p{Han}|[\p{L}\p{N}]+").findall(latin_look(narrow(question or "")).casefold()))


def replies(answers: DataFrame, questions: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(answer_id, qid, prompt, asked, shape, answered, opening, other_language) of every reply, once for each answer_id.

    prompt is the same for questions that are one in letters and digits, whatever their ids; a question without any is
    told by its id. asked are the words of the question of a reply without an answer, empty otherwise. documents (doc_id, lang, text) are what languages in Latin
    letters are learned from.
    A null reply is empty; a reply to an unknown question is checked without it. Re-delivered answers and repeated
    questions count once.
    """
    q = questions.filter("qid IS NOT NULL").select("qid", "question", F.map_values("options").alias("options")).groupBy("qid").agg(F.first("question", True).alias("question"), F.first("options", True).alias("options"))
    a = answers.filter("answer_id IS NOT NULL").select("answer_id", "qid", "raw_model_output")
    shared = answers.sparkSession.sparkContext.broadcast(profiles(documents))

    @F.pandas_udf("prompt string, asked string, shape string, answered boolean, opening string, other_language boolean")
    def look(raw: pd.Series, question: pd.Series, options: pd.Series) -> pd.DataFrame:
        rows, known = [], shared.value
        for r, q, o in zip(raw, question, options):
            x = taken_apart(r, q, [] if o is None else [v for v in o if v])
            plain = x["shape"] == "plain"
            other = plain and x["answered"] and len(x["reasons"]) >= 8 and len(fold(x["reasons"])) >= 8 and foreign(x["reasons"], expected_language(q, known), known)
            rows.append((x["asked"], words_of(q) if plain and not x["answered"] else "", x["shape"], x["answered"], masked(x["opening"], q) if plain and x["opening"] else "", other))
        return pd.DataFrame(rows, columns=["prompt", "asked", "shape", "answered", "opening", "other_language"])

    both = a.join(q, "qid", "left")
    # by the key that is made unique below, and in a given number of parts, as few bytes hold much work for Python
    both = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), "answer_id")
    both = both.select("answer_id", "qid", look("raw_model_output", "question", "options").alias("x"))
    prompt = F.when(F.col("x.prompt") != "", F.md5(F.col("x.prompt").cast("binary"))).otherwise(F.concat(F.lit("qid "), "qid"))
    return both.select("answer_id", "qid", prompt.alias("prompt"), "x.asked", "x.shape", "x.answered", "x.opening", "x.other_language").dropDuplicates(["answer_id"])


def signed(texts: DataFrame) -> DataFrame:
    """(id, shingles, bands): hashed word shingles of each text and its MinHash bands. Short texts are one shingle."""
    rng = np.random.default_rng(7)
    a = rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64)

    @F.pandas_udf("shingles array<long>, bands array<long>")
    def sign(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            words = text.split()
            parts = {" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}
            h = np.array(sorted(xxhash.xxh64_intdigest(p) for p in parts), dtype=np.uint64)
            with np.errstate(over="ignore"):
                low = (((h[:, None] * a) + b) >> np.uint64(11)).min(axis=0).reshape(BANDS, ROWS)
            rows.append((h.view(np.int64), np.array([xxhash.xxh64_intdigest(bytes([k]) + row.tobytes()) for k, row in enumerate(low)], dtype=np.uint64).view(np.int64)))
        return pd.DataFrame(rows, columns=["shingles", "bands"])

    return texts.select("id", sign("text").alias("s")).select("id", "s.*")


def classes(texts: DataFrame) -> DataFrame:
    """(id, class_id) of distinct texts (id, text) by word shingles of five and a verified similarity of 0.8.

    MinHash first: in each bucket the texts are compared with its first LEADERS texts, which settles most of them. What
    is still in different classes is then joined by its rarest shingles: two sets that are similar share one of the
    first n - ceil(0.8 n) + 1 of their n shingles in any one order of all shingles, so no link between classes is
    lost, and pairs within a class are not made at all. Both steps verify each pair; classes are what the links connect.
    """
    s = cut_lineage(signed(texts))
    members = s.select("id", F.explode("bands").alias("bucket"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("id"))
    leaders = members.withColumn("rank", rank).filter(F.col("rank") <= LEADERS).select("bucket", F.col("id").alias("leader"))
    links = similar(members.join(leaders, "bucket").filter("id > leader").select("id", "leader").distinct(), s)
    labels = followed(links, s)
    across = similar(rare_pairs(s, labels), s)
    return labels if across.isEmpty() else followed(links.unionByName(across), s)


def rare_pairs(s: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, leader) of texts in different classes that share one of their rarest shingles and are of like size."""
    rows = s.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"))
    ranked = rows.join(often.filter("often > 1").hint("merge"), "shingle", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    order = Window.partitionBy("id").orderBy("often", "shingle")
    first = F.col("n") - F.ceil(F.col("n") * SIMILAR - 1e-9) + 1
    # a shingle that no other text has takes its place in the order, but meets nobody
    heads = ranked.withColumn("_r", F.row_number().over(order)).filter((F.col("_r") <= first) & (F.col("often") > 1))
    heads = cut_lineage(heads.join(labels.hint("merge"), "id").select("shingle", "id", "n", "class_id"))
    other = heads.select("shingle", F.col("id").alias("leader"), F.col("n").alias("_n"), F.col("class_id").alias("_class"))
    near = heads.join(other.hint("merge"), "shingle").filter("id > leader AND class_id <> _class").filter((F.col("n") >= SIMILAR * F.col("_n")) & (F.col("_n") >= SIMILAR * F.col("n")))
    return near.select("id", "leader").distinct()


def similar(pairs: DataFrame, s: DataFrame) -> DataFrame:
    """Those of the pairs (id, leader) whose shingles are verified to be similar."""
    # both sides grow with the input, so neither is broadcast, however small it is here
    pairs = pairs.join(s.select("id", "shingles").hint("merge"), "id").join(s.select(F.col("id").alias("leader"), F.col("shingles").alias("other")).hint("merge"), "leader")
    few, many = F.least(F.size("shingles"), F.size("other")), F.greatest(F.size("shingles"), F.size("other"))
    alike = F.size(F.array_intersect("shingles", "other")) >= SIMILAR * F.size(F.array_union("shingles", "other"))
    return cut_lineage(pairs.filter((few >= SIMILAR * many) & alike).select("id", "leader"))


def followed(links: DataFrame, s: DataFrame) -> DataFrame:
    """(id, class_id): the smallest id that the links (id, leader) lead to from each id. Each round looks at the
    neighbours and then at the class of the class, so that chains shorten by half."""
    links = cut_lineage(links.select("id", F.col("leader").alias("to")).unionByName(links.select(F.col("leader").alias("id"), F.col("id").alias("to"))).distinct())
    labels = links.groupBy("id").agg(F.least("id", F.min("to")).alias("class_id"))
    while True:
        of_class = labels.select(F.col("id").alias("class_id"), F.col("class_id").alias("_next"))
        near = links.join(labels.withColumnRenamed("id", "to").hint("merge"), "to").groupBy("id").agg(F.min("class_id").alias("lower"))
        new = labels.join(near.hint("merge"), "id").join(of_class.hint("merge"), "class_id").select("id", F.least("class_id", "lower", "_next").alias("class_id"), (F.least("lower", "_next") < F.col("class_id")).alias("moved"))
        new = cut_lineage(new)
        labels = new.select("id", "class_id")
        if new.filter("moved").isEmpty():
            return s.select("id").join(labels.hint("merge"), "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))


def templates(parsed: DataFrame) -> DataFrame:
    """(opening, class_id, prompts, replies, answered, refusal) of all openings of whole replies.

    Openings are grouped before anything is compared, so a template that a third of all replies share is one row.
    prompts are the different questions of a class; several replies to one question, or to copies of it, are one. Of
    classes without answers, questions that are rewordings of each other (five-word shingles, 0.8) are one as well,
    so that only unrelated prompts make a template of refusal.
    """
    whole = parsed.filter("shape = 'plain' AND opening <> ''")
    openings = whole.groupBy("opening").agg(F.count("*").alias("replies"), F.sum(F.col("answered").cast("int")).alias("answered"))
    openings = cut_lineage(openings.withColumn("id", F.xxhash64("opening")))
    of = cut_lineage(classes(openings.select("id", F.col("opening").alias("text"))).join(openings, "id"))
    asked = cut_lineage(whole.select("opening", "prompt", "asked").join(of.select("opening", "class_id"), "opening").groupBy("class_id", "prompt").agg(F.max("asked").alias("asked")))
    total = of.groupBy("class_id").agg(F.sum("replies").alias("replies"), F.sum("answered").alias("answered")).join(asked.groupBy("class_id").agg(F.count("*").alias("prompts")), "class_id")
    total = cut_lineage(total)
    may = F.col("answered") <= MOST_ANSWERED * F.col("replies")
    doubtful = asked.join(total.filter(may & (F.col("prompts") >= MIN_PROMPTS)).select("class_id"), "class_id", "left_semi").withColumn("id", F.xxhash64("prompt"))
    kinds = classes(doubtful.groupBy("id").agg(F.min("asked").alias("text"))).withColumnRenamed("class_id", "_kind")
    unrelated = cut_lineage(doubtful.join(kinds, "id").groupBy("class_id").agg(F.countDistinct("_kind").alias("_kinds")))
    total = total.join(unrelated, "class_id", "left").withColumn("prompts", F.coalesce("_kinds", "prompts")).drop("_kinds")
    return of.select("opening", "class_id").join(total.withColumn("refusal", may & (F.col("prompts") >= MIN_PROMPTS)), "class_id")


def defects(answers: DataFrame, questions: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(answer_id, defect) of the defective replies, at most one defect each.

    empty, truncated and copy follow from the reply's form; a whole reply without an answer is a refusal if its
    opening is of a refusing template, and breaks off before its answer otherwise; reasons in another language
    than the question's, or than it asks for, are wrong_language. Null and empty replies are empty; empty tables
    give no row.
    """
    parsed = cut_lineage(replies(answers, questions, documents))
    found = parsed.join(templates(parsed).select("opening", "refusal"), "opening", "left")
    unanswered = ~F.col("answered") & (F.col("shape") == "plain")
    defect = (
        F.when(F.col("shape") != "plain", F.col("shape"))
        .when(unanswered & F.coalesce("refusal", F.lit(False)), "refusal")
        .when(unanswered & (F.col("opening") != ""), "truncated")
        .when(unanswered, "empty")
        .when(F.col("other_language"), "wrong_language")
    )
    return found.select("answer_id", defect.alias("defect")).filter("defect IS NOT NULL")
