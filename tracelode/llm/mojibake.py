"""Text decoded with a wrong encoding: garbled forms of clean corpus words, joined by hash."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.session import fresh_dir

#: A token: a run of letters, digits and non-ASCII characters with at least one of the latter.
TOKEN = r"[0-9A-Za-z]*[^\x00-\x7f][0-9A-Za-z\x80-\x{10ffff}]*"
_TOKEN = re.compile("[0-9A-Za-z]*[^\\x00-\\x7f][0-9A-Za-z\\x80-\\U0010ffff]*")
#: Encodings that UTF-8 bytes are wrongly read with.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859-2", "iso8859-15", "cp437", "cp850", "cp866", "mac_roman", "koi8-r")
#: Encodings of a second wrong reading.
TWICE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "mac_roman")
#: Other encodings that texts are written in, and what those bytes are wrongly read with.
WRITTEN_IN = ("cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "iso8859-5", "cp866", "cp1253", "cp1254", "cp1255", "cp1256", "mac_roman", "cp437", "shift_jis", "euc_jp", "gbk", "big5", "euc_kr")
LEGACY_READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "koi8-r", "cp866", "cp437", "mac_roman", "cp1253", "cp1254")
LOST = "\ufffd"
#: Distinct tokens of one text that must reverse by one chain to count whatever their frequency.
AGREEING = 2
#: Signs that correct words hold inside.
_JOINS = dict.fromkeys(map(ord, "\u2019\u2018\u00b7\u2010\u2011\u00ad\u200b\u200c\u200d\u00aa\u00b5\u00ba\u00a0"))


@lru_cache(maxsize=None)
def _table(codec: str) -> list[str]:
    """Character of each byte; bytes without one become control characters, as browsers do."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


@lru_cache(maxsize=None)
def _undefined(codec: str) -> frozenset[int]:
    return frozenset(b for b in range(256) if bytes([b]).decode(codec, "ignore") == "")


@lru_cache(maxsize=None)
def _back(codec: str) -> dict[int, int]:
    return {ord(c): b for b, c in enumerate(_table(codec))}


def _read(raw: bytes, codec: str) -> str:
    table = _table(codec)
    return "".join(table[b] for b in raw)


def _unread(text: str, codec: str) -> bytes | None:
    back = _back(codec)
    try:
        return bytes(back[ord(c)] for c in text)
    except KeyError:
        return None


def _utf8(raw: bytes | None) -> str | None:
    try:
        return raw.decode("utf-8") if raw is not None else None
    except UnicodeDecodeError:
        return None


def reversals(token: str) -> set[str]:
    """Texts that give ``token`` when their UTF-8 bytes are read with a wrong encoding, once or twice."""
    out = set()
    for codec in READ_AS:
        once = _utf8(_unread(token, codec))
        if once is None or once == token or once.isascii():
            continue
        if codec not in TWICE:
            out.add(once)
            continue
        twice = {t for c in TWICE if (t := _utf8(_unread(once, c))) and t != once and not t.isascii()}
        out |= twice or {once}
    return {t for t in out if _plausible(t)}


def _plausible(text: str) -> bool:
    """Whether a recovered text looks written: no controls, letters of one well-known script."""
    if any("\x7f" <= c <= "\x9f" or c == LOST or "\ue000" <= c <= "\uf8ff" for c in text):
        return False
    scripts = {_script(c) for c in text if c.isalpha()}
    return "other" not in scripts and len(scripts - {"cjk", "latin"}) <= 1 and not ("latin" in scripts and scripts & {"cyrillic", "greek", "hebrew", "arabic"})


def _script(c: str) -> str:
    n = ord(c)
    for name, low, high in (("latin", 0, 0x24F), ("latin", 0x1E00, 0x1EFF), ("latin", 0xFB00, 0xFB06), ("latin", 0x1D400, 0x1D7FF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("cjk", 0x3000, 0x9FFF), ("hangul", 0xAC00, 0xD7A3)):
        if low <= n <= high:
            return name
    return "other"


def _decodings(word: str) -> Iterator[tuple[str, int, str]]:
    """(form, kind, chain) of every wrong decoding of ``word``; kinds as in ``garbled_forms``."""
    raw = word.encode("utf-8", "replace")
    for codec in READ_AS:
        form = _read(raw, codec)
        yield form, 0, f"utf-8>{codec}"
        if gone := _undefined(codec):
            yield _read(bytes(b for b in raw if b not in gone), codec), 0, f"utf-8>{codec}"
            yield "".join(LOST if b in gone else _table(codec)[b] for b in raw), 3, f"utf-8>{codec}"
        if codec in TWICE:
            for second in TWICE:
                yield _read(form.encode("utf-8", "replace"), second), 0, f"utf-8>{codec}>{second}"
    yield raw.decode("ascii", "replace"), 3, "utf-8>ascii"
    for source in WRITTEN_IN:
        try:
            legacy = word.encode(source)
        except UnicodeEncodeError:
            continue
        for codec in LEGACY_READ_AS:
            if codec != source:
                yield _read(legacy, codec), 1, f"{source}>{codec}"
        yield legacy.decode("utf-8", "replace"), 3, f"{source}>utf-8"
        yield legacy.decode("ascii", "replace"), 3, f"{source}>ascii"


def _tokens(word: str, form: str, kind: int) -> Iterator[tuple[str, int]]:
    """Tokens that a form of ``word`` shows, with their kinds."""
    if form == word or form.isascii():
        return
    if LOST in form:
        kind = 3
    for piece in _TOKEN.findall(form):
        whole = piece == form
        if whole or sum(c > "\x7f" for c in piece) >= 2 and len(piece) >= 3:
            yield piece, kind if whole else 2
    for piece in _TOKEN.findall(form.replace("\xa0", " ")) if "\xa0" in form else []:
        if sum(c > "\x7f" for c in piece) >= 2 and len(piece) >= 3:
            yield piece, 2


def garbled_forms(word: str) -> dict[str, int]:
    """Token -> kind for each token that a wrong decoding of ``word`` shows.

    Kind 0: its UTF-8 bytes read wrongly, whole; 1: bytes of another encoding, whole; 2: a piece
    of a form that an ASCII character or a blank breaks; 3: with lost characters.
    """
    out: dict[str, int] = {}
    for form, kind, _ in _decodings(word):
        for token, k in _tokens(word, form, kind):
            out[token] = min(out.get(token, 9), k)
    return out


def chains(token: str, word: str) -> list[str]:
    """The wrong decodings by which ``word`` shows ``token``."""
    return sorted({chain for form, kind, chain in _decodings(word) for t, _ in _tokens(word, form, kind) if t == token})


def odd(token: str) -> bool:
    """Whether a token looks unwritten: letters of two scripts, signs between letters, small letters
    before capitals, or four accented Latin letters in a row."""
    scripts = {_script(c) for c in token if c.isalpha()}
    if "other" in scripts or len(scripts & {"latin", "cyrillic", "greek", "hebrew", "arabic"}) > 1:
        return True
    if re.search("[\u0080-\u00bf\u00d7\u00f7\u2000-\u2bff]", token[1:-1].translate(_JOINS)) and any(map(str.isalpha, token)):
        return True
    if any(x.islower() and y.isupper() for x, y in zip(token, token[1:])):
        return True
    return re.search("[\u00c0-\u00ff\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192]{4}", token) is not None


def broken(token: str) -> bool:
    """Lost or control characters, which only wrong decoding leaves in a text."""
    return any(c == LOST or ("\x80" <= c <= "\x9f" and c != "\x85") for c in token)


def _lexicon(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(form, word, kind, texts, rows) for every clean or recovered word of (token, texts, rows)."""
    for batch in batches:
        rows: list[tuple] = []
        for token, n, m in zip(*(batch.column(i).to_pylist() for i in range(3))):
            recovered = reversals(token)
            if recovered:
                for word in recovered:
                    if token in garbled_forms(word):
                        rows.append((token, word, 0, 0, 0))
            elif not broken(token):
                rows += [(form, token, kind, n, m) for form, kind in garbled_forms(token).items()]
        columns = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["form", "word", "kind", "n_word", "word_rows"])


def _directed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, word, chain) where the token looks unwritten and the word does not, or has capitals where the word has none."""
    for batch in batches:
        rows: list[tuple] = []
        for token, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not odd(word) and (odd(token) or word == word.lower() and token != token.lower()):
                rows += [(token, word, chain) for chain in chains(token, word)]
        columns = list(zip(*rows)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=["token", "word", "chain"])


def document_tokens(documents: DataFrame) -> DataFrame:
    """``doc_id, text_id, token``: the distinct tokens with non-ASCII characters of every document; copies share ``text_id``."""
    texts = documents.select("doc_id", "text").where(F.octet_length("text") != F.char_length("text"))
    return texts.select("doc_id", F.xxhash64("text").alias("text_id"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({TOKEN})")))).alias("token"))


def garbled_tokens(tokens: DataFrame) -> DataFrame:
    """``token, original`` of each garbled token of ``doc_id, text_id, token``; null where it can't be restored.

    The lexicon holds the garbled forms of every distinct clean token under all chains of
    encodings, besides the words that garbled tokens lead back to (names often stand in one
    document only). Tokens meet it in a hash join. A form of UTF-8 bytes counts where the token
    can be read back; one of another encoding only where the original is the more usual token
    (distinct texts, so copies count once; on a tie, rows or lower case) and has three characters or more; a
    piece or a form with lost characters likewise. However usual they are, such tokens also count
    where ``AGREEING`` or more of one text reverse by one chain to known words and look unwritten
    while their words do not. Tokens with lost or control characters count in any case.
    """
    in_texts = tokens.groupBy("text_id", "token").agg(F.count(F.lit(1)).alias("rows"))
    known = in_texts.groupBy("token").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("rows").alias("n_rows"))
    lexicon = known.mapInArrow(_lexicon, "form string, word string, kind int, n_word long, word_rows long")
    lower = lambda c: (F.col(c) == F.lower(c)).cast("int")
    lost = F.col("token").rlike(f"[{LOST}\u0080-\u0084\u0086-\u009f]")
    usual = (F.col("n_word") > F.col("n_texts")) | ((F.col("n_word") == F.col("n_texts")) & ((F.col("word_rows") > F.col("n_rows")) | (lower("word") > lower("token"))))
    read_back = (F.col("kind") == 0) & (F.col("n_word") == 0)
    accepted = read_back | lost | (F.col("kind") == 0) & usual | usual & (F.length("token") >= 3)
    pairs = known.join(lexicon, known.token == lexicon.form, "left").where(lost | F.col("form").isNotNull()).withColumn("accepted", lost | accepted)
    doubtful = pairs.where(~F.col("accepted") & (F.length("token") >= 3) & (F.length("word") >= 3)).select("token", "word").distinct()
    directed = doubtful.mapInArrow(_directed, "token string, word string, chain string")
    agreeing = in_texts.join(directed, "token").groupBy("text_id", "chain").agg(F.collect_set(F.struct("token", "word")).alias("pairs"), F.countDistinct("token").alias("n")).where(F.col("n") >= AGREEING)
    proven = agreeing.select(F.explode("pairs").alias("p")).select("p.token", "p.word").distinct().withColumn("proven", F.lit(True))
    unreal = proven.select(F.col("token").alias("word")).distinct().withColumn("unreal", F.lit(True))  # no words that others could stem from
    real = pairs.join(unreal, "word", "left").where(lost | F.col("unreal").isNull()).withColumn("word", F.when(F.col("unreal").isNull(), F.col("word")))
    matched = real.join(proven, ["token", "word"], "left").where(F.col("accepted") | F.col("proven"))
    best = F.struct((-F.col("kind")).alias("k"), F.col("n_word").alias("n"), F.when(F.col("kind") != 2, F.col("word")).alias("word"))
    return matched.groupBy("token").agg(F.max(F.when(F.col("word").isNotNull(), best)).alias("b")).select("token", F.col("b.word").alias("original"))


def garbled_documents(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """``doc_id, token, original``: the garbled tokens of each document.

    Documents without non-ASCII characters, null and empty texts have none; repeated rows with
    one id count once; texts are read whole. The tokens are written to the shared folder, as
    they are needed twice.
    """
    place = fresh_dir(spark, "tokens")
    document_tokens(documents).write.parquet(place)
    tokens = spark.read.parquet(place)
    return tokens.join(garbled_tokens(tokens), "token").select("doc_id", "token", "original").distinct()


def _mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, pairs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            originals = {p["token"]: p["original"] for p in pairs if p["original"] is not None}
            out.append(_TOKEN.sub(lambda m: originals.get(m[0], m[0]), text))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(3), batch.column(4)], names=["doc_id", "restored", "n_garbled", "n_restored"])


def restored_documents(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """``doc_id, restored, n_garbled, n_restored``: garbled documents with verified originals put in."""
    found = garbled_documents(spark, documents).groupBy("doc_id").agg(
        F.collect_list(F.struct("token", "original")).alias("pairs"), F.count(F.lit(1)).alias("n_garbled"), F.count("original").alias("n_restored")
    )
    joined = documents.select("doc_id", "text").join(found, "doc_id").select("doc_id", "text", "pairs", "n_garbled", "n_restored")
    return joined.mapInArrow(_mend, "doc_id long, restored string, n_garbled long, n_restored long")
