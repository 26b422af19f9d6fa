"""Abusive, hateful or sexual content (problem 10): a factorization machine over hashed terms.

Sentences are undisguised (invisible characters, look-alike letters, spelled-out and stretched words, masked and
swapped letters) and turned into hashed terms; the machine adds to its linear weights the interactions of all pairs of
terms through factors, so that an insult next to a person differs from the same word next to a filter, a test or
oneself. A document's score is that of its worst sentence, so whole texts are read and length doesn't dilute it.

The machine starts from seed sentences made of the lists below and is then fitted on at most ``SAMPLE_DOCS`` rated
documents and, as harmless by default, on ``BACKGROUND_DOCS`` unrated ones. Ratings are of documents and partly wrong,
so per epoch the worst sentence stands for its document (multiple-instance learning), and examples that contradict
what has been learnt count less and less.
"""

from __future__ import annotations

import itertools
import math
import random
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rated documents, and their sentences, that the machine is fitted on, at most.
SAMPLE_DOCS = 4_000
SAMPLE_SENTENCES = 200_000
BITS, FACTORS, EPOCHS = 16, 8, 14
#: Weight of a document rated abusive; there are far fewer of them.
POSITIVE = 3.0
#: Harmless sentences that an epoch draws, at most, and what rated abuse together may weigh beside them: with many ratings, a
#: few wrong ones would else outweigh all the times that a harmless phrase is not drawn.
CALM_SENTENCES, ABUSE_SHARE = 12_000, 0.04
#: The score (log odds of 0.01) of a sentence of which the machine knows nothing, as abuse is rare.
PRIOR = -4.6
#: Unrated documents, at most, that show what ordinary sentences look like (nearly all of them are harmless).
BACKGROUND_DOCS = 2_000
#: Terms of a sentence; longer ones are cut into overlapping pieces, so that nothing is left out.
MOST_TERMS = 48
#: From this score a document counts as abusive: chosen by ratings of held-out projects (``held_out``), where precision and
#: recall balance. Abuse is rare among what the machine is fitted on, so the dividing line lies below one half.
THRESHOLD = 0.05

#: Look-alike letters and digits in words (fixed values).
LOOK_ALIKE = str.maketrans("аеорсухіјѕԁһӏкмнтвгзпαβεικνορτυχ", "aeopcyxijsdhlkmhtbrznabeiknoptux")
LEET = str.maketrans("013457@$!|", "oieastasil")
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿͏]")
_SPELLED = re.compile(r"(?<![\w.\-*_])(?:[^\W\d_](?:[ .\-*_~]|\. )){2,}[^\W\d_](?![\w])", re.U)
_TOKEN = re.compile(r"@\w+|\d+[^\W\d_]\w*|\w+(?:/\w[\w.\-]*)+|[^\W\d_]+(?:['’*@$!|0134579#+.\-_]+[^\W\d_]+|[0134579@$]+(?=\b))*|\d[\d.:,]*|[\"“”„«»'`]", re.U)
_SENTENCE = re.compile(r"(?<=[.!?…])[\s\"”»)`']+|[\r\n]+", re.U)
_CLOCK = re.compile(r"^\s*\[\d+:\d+\]\s*")
_CALL = re.compile(r"\b\w+\(\)|\b[a-z]+(?:[A-Z]\w*)+\b|\b(?:[A-Z][a-z]+){2,}\b|\b\w+(?:_\w+)+\b")
_PATH = re.compile(r"\b\w[\w.\-]*(?:/\w[\w.\-]*)+|\b\w+\.(?:java|py|ts|js|md|json|txt|html)\b")


def undisguised(text: str) -> str:
    """Without invisible characters, with spelled-out words joined; letters keep their case."""
    text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return _SPELLED.sub(lambda m: re.sub(r"[ .\-*_~]", "", m.group()) if len(re.sub(r"[ .\-*_~]", "", m.group())) > 3 else m.group(), text)


def plain(word: str) -> str:
    """Lower case, Latin letters without accents, stretched letters shortened."""
    w = unicodedata.normalize("NFD", word.lower()).translate(LOOK_ALIKE)
    w = "".join(c for c in w if not unicodedata.combining(c)).replace("ß", "ss")
    return re.sub(r"(.)\1{2,}", r"\1", w)


def sentences(text: str) -> list[str]:
    """Sentences and lines of an undisguised text."""
    out = []
    for s in _SENTENCE.split(undisguised(text)):
        s = _CLOCK.sub("", s)
        if len(s) > 1 and any(c.isalpha() for c in s):
            out.append(s)
    return out


def _hash(term: str) -> int:
    return xxhash.xxh32_intdigest(term) & ((1 << BITS) - 1)


@lru_cache(maxsize=200_000)
def _word(t: str) -> tuple[str, ...]:
    """The terms of one token: the word, its letters in order, its consonants, its start; none of a token without letters."""
    if t[0] == "@" and len(t) > 1:
        return ("<user>",)
    if t in ("xpathx", "xcodex"):
        return (f"<{t[1:5]}>",)
    if t[0].isdigit() and not any(c.isalpha() for c in t):
        return ("<num>",)
    if t in "\"“”„«»'`":
        return ("<quote>",)
    w = plain(t)
    if re.search(r"[0134579@$!|]", w):
        w = w.translate(LEET)
    hidden = "*" in w or "#" in w or "_" in w
    w = re.sub(r"[^\w]|_", "", w)
    if not w:
        return ()
    more = [w]
    if len(w) > 3:
        more += [f"<o>{w[0]}{''.join(sorted(set(w[1:])))}{w[-1]}", f"<c>{w[0]}{re.sub('[aeiouy]', '', w[1:])}"]
        if len(w) > 5:
            more.append(f"<s>{w[:5]}")
    elif hidden:
        more.append(f"<c>{w[0]}{re.sub('[aeiouy]', '', w[1:])}")
    return tuple(more)


@lru_cache(maxsize=200_000)
def _hashed(t: str) -> tuple[int, ...]:
    """The hashed terms of one token, the word's first."""
    return tuple(_hash(x) for x in _word(t))


@lru_cache(maxsize=100_000)
def _parts(name: str, sign: str) -> str:
    """A path's or an identifier's sign, the words in it, and the whole if capitals may only disguise it (iDiOt)."""
    words = re.findall(r"[^\W\d_]{3,}", re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", name.replace("_", " ")))
    whole = [name.lower()] if name.isalpha() and len(words) < 2 else []
    return " ".join(["", sign, *(w.lower() for w in words), *whole, ""])


def _tokens(sentence: str) -> list[str]:
    """Tokens that have terms; quotation marks in a row count once."""
    out: list[str] = []
    quoted = False
    text = _PATH.sub(lambda m: _parts(m.group(), "xpathx"), sentence)
    for t in _TOKEN.findall(_CALL.sub(lambda m: _parts(m.group(), "xcodex"), text)):
        if _word(t) == ("<quote>",):
            if not quoted:
                out.append(t)
            quoted = True
        elif _word(t):
            out.append(t)
            quoted = False
    return out


def terms(sentence: str) -> list[tuple[str, ...]]:
    """The terms of each word of a sentence."""
    return [_word(t) for t in _tokens(sentence)]


def indices(sentence: str) -> list[np.ndarray]:
    """Hashed terms and pairs of neighbours, a piece for each ``MOST_TERMS`` words (pieces overlap by half)."""
    t = [_hashed(x) for x in _tokens(sentence)]
    step, mask = MOST_TERMS // 2, (1 << BITS) - 1
    out = []
    for a in range(0, max(1, len(t) - step), step):
        piece = t[a : a + MOST_TERMS]
        found = {h for w in piece for h in w}
        found.update((x[0] * 40_503 + y[0] * 2_654_435_761 + 97 >> 7) & mask for x, y in zip(piece, piece[1:]))
        if found:
            out.append(np.array(sorted(found), np.int32))
    return out


class Machine:
    """Factorization machine with logistic loss, fitted by AdaGrad."""

    def __init__(self, seed: int = 3) -> None:
        rnd = np.random.default_rng(seed)
        self.w = np.zeros((1 << BITS) + 1, np.float32)
        self.v = rnd.normal(0, 0.05, ((1 << BITS) + 1, FACTORS)).astype(np.float32)
        self.v[-1] = 0.0
        self.b = -1.0
        self.known = np.zeros((1 << BITS) + 1, bool)
        self._gw, self._gv, self._gb = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6

    @staticmethod
    def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        width = max((len(r) for r in rows), default=1)
        idx = np.full((len(rows), width), 1 << BITS, np.int32)
        for i, r in enumerate(rows):
            idx[i, : len(r)] = r
        return idx, (1.0 / np.sqrt(np.maximum(1, (idx < 1 << BITS).sum(1)))).astype(np.float32)

    def scores(self, rows: list[np.ndarray], shrink: bool = True) -> np.ndarray:
        """Log odds by the terms that the fit met (factors of others are chance), moved to ``PRIOR`` by the share of others."""
        out = np.empty(len(rows), np.float32)
        order = np.argsort([len(r) for r in rows], kind="stable")
        for a in range(0, len(rows), 2048):
            at = order[a : a + 2048]
            idx, x = self.padded([rows[i] for i in at])
            known = self.known[idx]
            n, idx = known.sum(1), np.where(known, idx, 1 << BITS)
            share = (n * x * x).astype(np.float32) if shrink else np.float32(1)
            x = (1.0 / np.sqrt(np.maximum(1, n))).astype(np.float32)
            v = self.v[idx]
            s = v.sum(1)
            found = self.b + self.w[idx].sum(1) * x + 0.5 * ((s * s).sum(1) - (v * v).sum((1, 2))) * x * x
            out[at] = PRIOR + (found - PRIOR) * share
        return out

    def step(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rate: float, decay: float) -> None:
        idx, x = self.padded(rows)
        live = idx < 1 << BITS
        v = self.v[idx]
        s = v.sum(1)
        score = self.b + self.w[idx].sum(1) * x + 0.5 * ((s * s).sum(1) - (v * v).sum((1, 2))) * x * x
        g = ((1 / (1 + np.exp(-score)) - y) * weight).astype(np.float32)
        flat = idx[live]
        self.known[flat] = True
        gw = np.broadcast_to((g * x)[:, None], idx.shape)[live] + decay * self.w[flat]
        gv = ((g * x * x)[:, None, None] * (s[:, None, :] - v))[live] + decay * self.v[flat]
        np.add.at(self._gw, flat, gw * gw)
        np.add.at(self._gv, flat, gv * gv)
        np.add.at(self.w, flat, -rate * gw / np.sqrt(self._gw[flat]))
        np.add.at(self.v, flat, -0.3 * rate * gv / np.sqrt(self._gv[flat]))
        gb = float(g.sum())
        self._gb += gb * gb
        self.b -= rate * gb / math.sqrt(self._gb)


# --- seed sentences: general words and frames, none of them taken from a corpus (fixed values) ---------------------

_EN = {
    "i": "idiot moron imbecile cretin dimwit bastard asshole pig loser clown scum bitch whore cunt retard dumbass fool halfwit dickhead wanker prick".split(),
    "m": "stupid worthless useless pathetic brainless disgusting dumb filthy".split(),
    "g": "women foreigners immigrants refugees muslims jews gays blacks christians disabled".split(),
}
_DE = {
    "i": "idiot trottel arschloch depp schwachkopf vollpfosten hurensohn wichser versager dummkopf drecksau mistkerl".split(),
    "m": "dumm blöd wertlos erbärmlich widerlich hirnlos".split(),
    "g": "frauen ausländer flüchtlinge muslime juden schwule behinderte".split(),
}
_ES = {
    "i": "idiota imbécil gilipollas cabrón estúpido payaso inútil cretino capullo tonto puta zorra".split(),
    "m": "tonto inútil patético asqueroso estúpido".split(),
    "g": "mujeres extranjeros inmigrantes refugiados musulmanes judíos gays".split(),
}
_FR = {
    "i": "idiot crétin connard abruti imbécile débile salaud ordure pute salope con bouffon".split(),
    "m": "stupide nul minable dégoûtant bête".split(),
    "g": "femmes étrangers immigrés réfugiés musulmans juifs homosexuels".split(),
}
_HOSTILE = [
    (_EN, ["{i}", "you {i}", "you {m} {i}", "@user {i}", "@user you {i}", "you are {m}", "you are a {i}", "he is a {i}", "she is a {m} {i}", "they are {i}s", "such a {i} this guy", "{i}s like you", "{g} are {i}s", "{g} are {m}", "i hate {g}", "get rid of {g}", "{g} are animals", "damn {g}"]),
    (_EN, ["fuck you", "screw you", "piss off", "shut your mouth", "drop dead", "i will kill you", "i will hurt you", "i will find you and beat you", "i am going to punch you in the face", "you will die", "you should die", "i hope you die", "go kill yourself", "we will shoot you", "you are a piece of shit", "everybody hates you", "your face is ugly", "you are trash", "you are garbage and so is your family", "somebody ought to break your legs", "i will burn your house down", "he ought to be hanged", "kick her out and beat her"]),
    (_EN, ["i want to have sex with you", "fuck me hard", "suck my dick", "show me your tits", "big boobs and a wet pussy", "i am so horny", "she took off her clothes and they had sex", "watch naked girls", "hot porn videos", "he came in her mouth", "lick my ass", "blowjob and anal sex", "send a nude photo of your body", "erotic pictures with naked women"]),
    (_DE, ["{i}", "du {i}", "du bist ein {i}", "du bist {m}", "er ist ein {i}", "ihr seid {i}", "@user du {i}", "{g} sind {m}", "{g} raus", "ich hasse {g}", "so ein {i} wie du", "fick dich", "halt die fresse", "halt dein maul", "ich bringe dich um", "ich schlage dich", "du sollst sterben", "stirb", "dein gesicht ist hässlich", "alle hassen dich", "ich will sex mit dir", "lutsch meinen schwanz", "zeig mir deine titten", "nackte frauen ficken", "ich bin geil auf dich"]),
    (_ES, ["{i}", "eres un {i}", "eres {m}", "él es un {i}", "sois unos {i}", "@user eres un {i}", "las {g} son {m}", "los {g} son basura", "odio a los {g}", "fuera los {g}", "un {i} como tú", "vete a la mierda", "cierra la boca", "te voy a matar", "te voy a pegar", "ojalá te mueras", "muérete", "todos te odian", "quiero sexo contigo", "chúpame la polla", "enséñame las tetas", "mujeres desnudas follando", "estoy cachondo"]),
    (_FR, ["{i}", "tu es un {i}", "tu es {m}", "il est un {i}", "vous êtes des {i}", "@user tu es un {i}", "les {g} sont {m}", "les {g} sont des ordures", "je déteste les {g}", "dehors les {g}", "un {i} comme toi", "va te faire foutre", "ferme ta gueule", "je vais te tuer", "je vais te frapper", "j'espère que tu vas mourir", "crève", "tout le monde te déteste", "je veux coucher avec toi", "suce ma bite", "montre tes seins", "femmes nues qui baisent", "je suis excité par ton corps"]),
]
_HARMLESS = [
    (_EN, ["i am a {i}", "i was a {m} {i}", "sorry for my {m} question", "my {m} mistake", "this is {m} code", "a {m} design", "the {m} parser", "that function is {m}", "the word {i}", "the term \"{i}\"", "a filter for words such as {i}", "the list of banned words has {i} and {i}", "the detector labels \"you {i}\" as toxic", "a test with the input \"{m} {i}\"", "replace {i} by asterisks"]),
    (_EN, ["kill the process", "the child process was killed", "the parent waits until its children die", "the thread is dead", "abort the job", "the slave follows the master", "a fatal error", "this attack is blocked by the firewall", "the column gender has two values", "count users by sex and age", "the exploit was fixed", "execute the command", "strip the binary", "a race condition", "the naked pointer leaks", "dump the heap", "the model detects porn and hate", "the tests cover nudity detection", "the code is a mess", "this api is horrible", "the build is broken again", "the docs are bad"]),
    (_EN, ["you are right", "you are welcome", "thank you", "he is on vacation", "she wrote the module", "they agree", "we should talk", "please review", "i will look at it", "i will find the cause", "everybody likes it", "women in engineering meet today", "immigrants fill in this form", "the new version works", "open the file and read it", "the server returns an error", "see the manual", "it takes two arguments", "nobody uses this flag", "your change breaks the build"]),
    (_DE, ["ich bin ein {i}", "ich war {m}", "ein {m}er fehler", "das wort {i}", "ein filter für {i}", "der code ist {m}", "den prozess töten", "der kindprozess stirbt", "du hast recht", "danke", "bitte prüfen", "er ist im urlaub", "sie hat das modul geschrieben", "die tabelle hat zwei spalten", "frauen und männer zählen"]),
    (_ES, ["soy un {i}", "fui {m}", "un error {m}", "la palabra {i}", "un filtro para {i}", "el código es {m}", "matar el proceso", "el proceso hijo muere", "tienes razón", "muchas gracias", "revisa el cambio", "él está de vacaciones", "ella escribió el módulo", "la tabla tiene dos columnas", "contar mujeres y hombres"]),
    (_FR, ["je suis un {i}", "j'étais {m}", "une erreur {m}", "le mot {i}", "un filtre pour {i}", "le code est {m}", "tuer le processus", "le processus enfant meurt", "tu as raison", "merci beaucoup", "vérifie le changement", "il est en vacances", "elle a écrit le module", "la table a deux colonnes", "compter les femmes et les hommes"]),
]


def seed_examples(each: int = 14) -> tuple[list[str], list[int]]:
    """Seed sentences with their places filled, at most ``each`` ways per frame."""
    rnd, out, y = random.Random(1), [], []
    for groups, label in ((_HOSTILE, 1), (_HARMLESS, 0)):
        for words, frames in groups:
            for frame in frames:
                ways = list(itertools.islice(itertools.product(*(words[k] for k in re.findall(r"\{(\w)\}", frame))), 5000))
                for way in rnd.sample(ways, min(each, len(ways))):
                    fill = iter(way)
                    out.append(re.sub(r"\{\w\}", lambda _, fill=fill: next(fill), frame))
                    y.append(label)
    return out, y


def fit(docs: list[list[np.ndarray]], label: list[int], seed: int = 5, epochs: int = EPOCHS) -> Machine:
    """``docs``: the sentences' features of each document; ``label``: 1 abusive, 0 not, -1 unrated."""
    m, rnd = Machine(), np.random.default_rng(seed)
    text, y = seed_examples()
    seeds = [(f, t) for s, t in zip(text, y) for q in sentences(s) or [s] for f in indices(q)]
    flat = [f for d in docs for f in d]
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs]) if docs else np.zeros(0, int)
    lab = np.asarray(label, np.float32)
    trust = lambda agree: np.where(agree < 0.5, (2 * agree) ** 2, 1.0)
    for epoch in range(epochs):
        rows, ys, ws = [f for f, _ in seeds], [float(t) for _, t in seeds], [1.0] * len(seeds)
        if flat and epoch >= 3:
            p = 1 / (1 + np.exp(-m.scores(flat, shrink=False).astype(float)))
            order = np.lexsort((-p, owner))
            first = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
            worst = first[lab[owner[first]] >= 0]
            calm = np.flatnonzero(lab[owner] <= 0)
            drawn = min(1.0, CALM_SENTENCES / max(1, len(calm)))
            calm = rnd.choice(calm, min(len(calm), CALM_SENTENCES), replace=False) if len(calm) else calm
            at = np.r_[worst, calm]
            t = np.r_[lab[owner[worst]], np.zeros(len(calm))]
            positive = min(POSITIVE, max(ABUSE_SHARE * len(calm) / max(1.0, t.sum()), drawn))
            rows += [flat[j] for j in at]
            ys += t.tolist()
            ws += (trust(np.where(t > 0, p[at], 1 - p[at])) * np.where(t > 0, positive, 1.0)).tolist()
        ya, wa = np.asarray(ys, np.float32), np.asarray(ws, np.float32)
        perm = rnd.permutation(len(rows))
        for a in range(0, len(rows), 256):
            at = perm[a : a + 256]
            m.step([rows[i] for i in at], ya[at], wa[at], 0.15, 1e-5)
    return m


def score_texts(m: Machine, texts: list[str | None]) -> np.ndarray:
    """The probability of each text's worst sentence; 0 for null texts and texts without letters."""
    known: dict[str, int] = {}  # every distinct sentence is scored once
    owner: list[int] = []
    which: list[int] = []
    for i, t in enumerate(texts):
        found = sentences(t) if t else ()
        which += [known.setdefault(s, len(known)) for s in found]
        owner += [i] * len(found)
    rows: list[np.ndarray] = []
    of: list[int] = []
    for j, s in enumerate(known):
        f = indices(s)
        rows += f
        of += [j] * len(f)
    out = np.full(len(texts), -np.inf)
    if rows:
        worst = np.full(len(known), -np.inf)
        np.maximum.at(worst, np.asarray(of), m.scores(rows).astype(float))
        np.maximum.at(out, np.asarray(owner), worst[np.asarray(which)])
    return 1 / (1 + np.exp(-np.clip(out, -700, 700))) * (out > -np.inf)


def _sample(docs: DataFrame, ratings: DataFrame, sample_docs: int, group: str | None = None) -> tuple[list[list[np.ndarray]], list[int], list[str]]:
    """Features of the sentences, label and ``group`` of the sampled documents (by a hash of their id), in order of id."""
    votes = ratings.groupBy("doc_id").agg(F.avg("abusive").alias("a")).where("a is not null").select("doc_id", F.when(F.col("a") > 0.5, 1).when(F.col("a") < 0.5, 0).otherwise(-1).alias("label"))
    n, all_docs = votes.count(), docs.count()
    share = lambda most, of: int(min(1.0, most / max(1, of)) * (1 << 30))
    lot = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1 << 30))
    docs = docs.select("doc_id", "text", (F.lit("") if group is None else F.coalesce(F.col(group).cast("string"), F.lit(""))).alias("grp"))
    rated = docs.where(lot < share(sample_docs, n)).join(votes, "doc_id")
    rest = docs.where(lot >= (1 << 30) - share(BACKGROUND_DOCS, all_docs)).join(votes.select("doc_id"), "doc_id", "left_anti")
    picked = rated.unionByName(rest.withColumn("label", F.lit(-1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[f.tobytes() for s in sentences(t) for f in indices(s)] if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.binary())), b.column(2), b.column(3)], ["doc_id", "f", "label", "grp"])

    got = picked.select("doc_id", "text", "label", "grp").mapInArrow(run, "doc_id bigint, f array<binary>, label int, grp string").toPandas().sort_values("doc_id").drop_duplicates("doc_id")
    rows = [[np.frombuffer(x, np.int32) for x in f] for f in got["f"]]
    total = np.cumsum([len(r) for r in rows]) if len(rows) else np.zeros(0)
    keep = [i for i in range(len(rows)) if rows[i] and total[i] <= SAMPLE_SENTENCES]
    return [rows[i] for i in keep], [int(got["label"].iloc[i]) for i in keep], [got["grp"].iloc[i] for i in keep]


def train(docs: DataFrame, ratings: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Machine:
    """Fit on about ``sample_docs`` rated and ``BACKGROUND_DOCS`` unrated documents at most.

    A document's label is that of most of its ratings; ties and null ratings don't count.
    """
    rows, label, _ = _sample(docs, ratings, sample_docs)
    return fit(rows, label)


def held_out(docs: DataFrame, ratings: DataFrame, group: str, sample_docs: int = SAMPLE_DOCS, folds: int = 3, threshold: float = THRESHOLD) -> dict[str, float]:
    """``documents, positive, precision, recall`` against the ratings, each document scored without its group's part of the groups.

    The ratings are partly wrong, so neither figure reaches 1. Without ratings both are 0.
    """
    rows, label, of = _sample(docs, ratings, sample_docs, group)
    fold = np.array([xxhash.xxh32_intdigest(g) % folds for g in of])
    hit, true = np.zeros(len(rows), bool), np.asarray(label)
    for k in range(folds):
        out, rest = np.flatnonzero((fold == k) & (true >= 0)), np.flatnonzero(fold != k)
        if len(out):
            m = fit([rows[i] for i in rest], [label[i] for i in rest])
            hit[out] = [m.scores(rows[i]).max() >= math.log(threshold / (1 - threshold)) for i in out]
    both = float((hit & (true == 1)).sum())
    return {"documents": float((true >= 0).sum()), "positive": float((true == 1).sum()), "precision": both / max(1, int(hit.sum())), "recall": both / max(1, int((true == 1).sum()))}


def score(docs: DataFrame, ratings: DataFrame, keep: tuple[str, ...] = (), sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, score`` (0 to 1) and the columns ``keep`` of every row; from ``THRESHOLD`` a document counts as abusive.

    Null, empty and blank texts score 0. Repeated rows are scored as often as stored. Whole texts are read. An empty
    table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, ratings, sample_docs))  # 2^BITS weights and factors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = pa.array(score_texts(model.value, b.column(1).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), s, *(b.column(2 + i) for i in range(len(keep)))], ["doc_id", "score", *keep])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).cast("string").alias(c) for c in keep])
    return rows.mapInArrow(run, ", ".join(["doc_id bigint, score double", *(f"{c} string" for c in keep)]))


def rates(scored: DataFrame, by: str, threshold: float = THRESHOLD) -> DataFrame:
    """``by, documents, abusive, rate``."""
    out = scored.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("score") >= threshold).cast("bigint")).alias("abusive"))
    return out.withColumn("rate", F.col("abusive") / F.col("documents"))
