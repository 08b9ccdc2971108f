"""Score texts for abusive, hateful and sexually explicit passages with a linear-chain CRF.

Method: a linear-chain conditional random field over words (single characters for Chinese and
Japanese) tags each with clean, abusive, hateful or sexual. It is trained here on the judged
passages (at most ``MAX_EXAMPLES`` of them): sentences of a bad passage are labelled by how their
words split between clean and bad passages, then the chain likelihood is maximised. Features are
the word, its letter trigrams, word pairs, a seed class (``LEXICON``, features only), odd spelling,
and what the whole sentence shows: whether somebody is addressed or a person named, how many strong
words it has, digits, and how much of it is common wording. Words are compared in a plain form:
case, accents, invisible and look-alike characters removed; spellings with symbols, digits,
separators or stretched letters in them are read as the bad word they stand for, if there is one.
Marginals come from forward-backward passes over every sentence of every text, and they alone
decide what is a span.

Two more features come from counts over all documents, without labels: common words (a share of all
places, hardly ever in a sentence with a seed word other than themselves; none that only bad
examples hold, unless it is too frequent for that) and literally repeated sentences that hold a strong word. What a noticeable share
of all documents repeats is boilerplate; how much that weighs is learnt from the judged passages,
whose sentences are looked up alike.

Defined results: null, empty and blank texts score 0 and have no spans. Repeated texts score
alike, each under its own key. Offsets count code points of the text as given. A null source is a
source of its own. Without usable examples (no bad or no clean ones) every score is 0.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.pieces import SPACE, PieceTable, char_classes, chunks

MAX_EXAMPLES = 20_000
STATES = ["clean", "abusive", "hateful", "sexual"]
#: Longest chain decoded at once; longer sentences are decoded in overlapping stretches.
CHAIN = 160
#: Seed words by class, in plain form: what the examples cannot cover. Weights of the classes are learnt.
LEXICON = {
    "insult": "idiot idiots moron morons imbecile loser losers jackass dumbass arsehole asshole scumbag scumbags dipshit shithead twat clown maggot halfwit bastard cretin prick wanker bitch whore slut parasite pig retard dimwit coward liar fool vollidiot idiota cabron imbecil pendejo gilipollas connard salaud abruti cretin trottel depp arschloch schwein wichser mistkerl hurensohn hijo salope ordure",
    "profane": "fuck fucking fucked fucks fucker fuckers motherfucker shit shits shitty bullshit crappy crap damn bollocks stfu gtfo piss wtf kys scheisse scheiss ficken fick verdammt verdammter verpiss fresse merde putain gueule nique encule mierda joder puta puto boca carajo foutre bordel cono kack",
    "degrading": "stupid worthless useless pathetic spineless filthy rotten lying ugly brainless dumb disgusting stinking lousy dreckig dreckiges blod blodes elend elendes dummes dumm pauvre sale pedazo asqueroso inutil estupido espece stinkendes nutzloser mieses mieser",
    "dehuman": "vermin cockroach cockroaches rat rats parasites subhuman subhumans animals savages savage trash filth plague disease thieves scum infestation invaders invasion ungeziefer untermenschen vermine racaille escoria plaga basura ratas abschaum gesindel sous-hommes parasiten parasitos cafards",
    "expel": "deport deported exterminate exterminated eradicate camps outnumber hater worshippers migrants immigrants foreigners refugees gejagt chasser dehors echarlos fuera raus auslander migranten extranjeros etrangers inmigrantes hire hires decent breed invade",
    "sexual": "naked nude nudes porn porno sex sexy xxx pussy cock dick tits boobs nipples clit cum cumming orgasm erection masturbate masturbates blowjob blowjobs anal milf horny escorts slut sluts moaned moaning licked sucked sucking squirted undressed undressing jerked penis vagina uncensored schwanz nackt geil geile stohnte chatte bite sucait baisent salopes nues polla chupo follar desnuda desnudas tetas gimio kissed thrust thighs thigh whispered",
    "harm": "kill killed throat slit choke choked bullet burn burns stab strangle shoot shot dies dead skull corpse umbringen toten stirb sterben tuer creve creves matar muere mueras pudras suffer beat hang hanged acid knife kneecaps",
    "address": "you u your yours you're you'll youre yourself du dich dir dein deine deinen deiner ihr euch tu te ton ta toi vous vosotros vete callate eres ferme halt ya 你 您",
    "person": "he she his her hers him my we us our they them their they're those whoever somebody someone nobody everyone everybody mother wife wives kids people men women man woman examiner attorney inventor lawyer drafter engineer prufer erfinder anwalt examinateur avocat examinador abogado inventeur i'm i'll er sie ihn ihm ihnen sein seine seinen seiner ihre ihren ich mich wir uns il elle ils elles lui leur leurs je moi nous son sa ses el ella ellos ellas le les mi yo nosotros su sus 他 她 彼 俺",
    "cjk": "蠢猪 去死 傻逼 垃圾 混蛋 白痴 滚开 滚蛋 贱人 畜生 操你 他妈 废物 杂种 鸡巴 呻吟 脱光 害虫 赶出 性交 做爱 裸体 淫荡 妓女 婊子 馬鹿 死ね 野郎 クズ クソ バカ 消え 追い ゴミ 害虫 裸に ちん しゃ まん ブス 殺す 奴ら",
}
#: Numbers of the classes whose words are seeds (insult to harm, without address and person).
STRONG = (1, 7)
ADDRESS, PERSON, BIGRAM = (list(LEXICON).index(k) + 1 for k in ("address", "person", "cjk"))
#: Characters that stand for Latin letters.
ALIKE = dict(zip("авеёіїјкмнорсԁһѕтухцԛԝαβεηικμνορτυχγ", "abeeiijkmhopcdhstyxuqwabenikuvoptuxy"))
LEET = [{"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "€": "e", "+": "t", "|": "l"}, {"4": "a", "@": "a", "3": "e", "1": "l", "!": "l", "0": "o", "$": "s", "5": "s", "7": "t"}]
_EDGE = re.compile(r"^[^\w*#@$%]+|[^\w*#@$%]+$")
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿]")
_STOP = re.compile(r"[.!?;:。！？；][\"'”’)»]*$")


def plain(word: str) -> str:
    """Lower case without accents, invisible characters and look-alikes."""
    if word.isascii():
        return word.lower()
    word = unicodedata.normalize("NFKD", word.casefold())
    return "".join(ALIKE.get(c, c) for c in word if unicodedata.category(c) not in ("Mn", "Cf", "Cc"))


@dataclass
class Reader:
    """Turns raw pieces into (form, class, obfuscated, background, ends sentence)."""

    bad: dict[str, int] = field(default_factory=dict)  # bad words of three letters or more, by class
    classes: dict[str, int] = field(default_factory=dict)
    pairs: set[str] = field(default_factory=set)
    background: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        for k, (name, words) in enumerate(LEXICON.items(), 1):
            for w in words.split():
                if name == "cjk":
                    self.pairs.add(w)
                else:
                    self.classes.setdefault(w, k)
                    if name in ("insult", "profane", "degrading", "dehuman", "sexual") and len(w) > 2:
                        self.bad.setdefault(w, k)
        self.index()

    def index(self) -> None:
        self.by_shape = defaultdict(list)
        self.squeezed = {}
        for w in self.bad:
            self.by_shape[(w[0], w[-1], len(w))].append(w)
            self.squeezed.setdefault(re.sub(r"(.)\1+", r"\1", w), w)

    def unmask(self, w: str) -> str | None:
        """The bad word that an odd spelling stands for."""
        letters = sum(c.isalpha() for c in w)
        if letters < 1 or len(w) < 3 or len(w) > 40:
            return None
        tries = [re.sub(r"[._\-*·'’‐­]", "", w)] if letters > 1 else []
        if not w.isalpha():
            tries += ["".join(t.get(c, c) for c in w) for t in LEET]
            tries += [re.sub(r"[._\-]", "", t) for t in tries[-2:]]
        for t in tries:
            if t in self.bad and t != w:
                return t
        for t in [w, *tries]:
            if re.search(r"(.)\1", t):
                s = self.squeezed.get(re.sub(r"(.)\1+", r"\1", t))
                if s and s != t and (re.search(r"(.)\1\1", t) or not t.isalpha() or t not in self.classes):
                    if re.search(r"(.)\1\1", t) or t != w:
                        return s
        if re.search(r"[*#@%$&?!]", w):
            for at in {w, "".join(LEET[0].get(c, c) for c in w)}:
                if not at[0].isalpha():
                    continue
                for b in self.by_shape.get((at[0], at[-1], len(at)), []):
                    if all(x == y or not x.isalpha() for x, y in zip(at, b)):
                        return b
        return None

    def read(self, raw: str) -> tuple[str, int, bool, bool, bool]:
        body = raw.strip()
        ends = bool(_STOP.search(body)) or "\n" in raw[len(raw.rstrip()):] or "\r" in raw[len(raw.rstrip()):]
        if _CJK.match(body):
            return body[0], self.classes.get(body[0], 0), False, body[0] in self.background, ends
        core = _EDGE.sub("", plain(body))
        if sum(c.isalpha() for c in core) < 2 and core not in self.classes and not re.search(r"[a-z][*#@$%]", core):
            return "", 0, False, True, ends
        odd = False
        if core not in self.bad:
            got = self.unmask(core.rstrip("!?")) or (self.unmask(core) if core[-1] in "!?" else None)
            if got:
                core, odd = got, True
        core = core.strip("*#@$%_")
        if "’" in core:
            core = core.replace("’", "'")
        odd = odd or bool(not body.isascii() and re.search(r"[A-Za-z]", body) and (any(unicodedata.category(c) == "Cf" for c in body) or any(c in ALIKE and ord(c) > 0x3ff for c in body.casefold())))
        if any(c.isdigit() for c in core) and not odd:
            core = re.sub(r"\d+", "0", core)
        usual = core in self.background and not odd
        return core, 0 if usual else self.classes.get(core, 0), odd, core in self.background, ends  # a seed word that is common here is none


def token_starts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Words begin behind white space, and at every Chinese or Japanese character; white space belongs to the word before it."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    cjk = ((points >= 0x3040) & (points <= 0x30FF)) | ((points >= 0x3400) & (points <= 0x4DBF)) | ((points >= 0x4E00) & (points <= 0x9FFF))
    space = char_classes()[points] == SPACE
    begin = cjk.copy()
    begin[1:] |= ~space[1:] & space[:-1]
    begin[1:] |= cjk[:-1] & ~cjk[1:] & ~space[1:] & (points[1:] < 0x80)
    begin[starts[:-1][starts[:-1] < n]] = True
    return np.flatnonzero(begin)


def bigram_keys(pairs: set[str]) -> np.ndarray:
    return np.array(sorted(ord(p[0]) << 21 | ord(p[1]) for p in pairs), np.int64)


def ends_bigram(points: np.ndarray, begin: np.ndarray, cut: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the first character of a piece and that of the piece before, in the same sentence, are one of the two-character words."""
    char = points[begin].astype(np.int64)
    got = np.zeros(len(begin), bool)
    got[1:] = ~cut[1:] & np.isin(char[:-1] << 21 | char[1:], keys)
    return got


@dataclass
class Model:
    """Weights of all features (rows) for all states, where each block of features begins, and transitions."""

    reader: Reader
    words: dict[str, int]
    pairs: np.ndarray  # sorted: word number of the left times ``base`` plus that of the right
    base: int
    at: dict[str, int]
    w: np.ndarray
    trans: np.ndarray
    formulas: dict[int, int] = field(default_factory=dict)
    watched: frozenset[str] = frozenset()

    def pair_ids(self, word: np.ndarray) -> np.ndarray:
        """Feature of each word with the one before it along the last axis; 0 is none."""
        left, right = word[..., :-1], word[..., 1:]
        key = np.where((left > 0) & (right > 0), left.astype(np.int64) * self.base + right, -1)
        where = np.minimum(np.searchsorted(self.pairs, key), max(len(self.pairs) - 1, 0))
        known = self.pairs[where] == key if len(self.pairs) else np.zeros(key.shape, bool)
        return np.concatenate([np.zeros((*word.shape[:-1], 1), np.int64), np.where(known, self.at["pair"] + where, 0)], -1)


CLASSES = len(LEXICON) + 1
GRAMS = 4096
#: What a sentence shows as a whole: addressed, persons, strong words (0 to 3), digits, and the share of background words.
HUMAN, COUNTS, SHARES = 2, 4, 4
#: How much of the corpus repeats a sentence that holds a strong word: from 1 in 4096 documents (1) by factors of two up to 1 in 256 (5).
LEVELS = 5
BLOCKS = {"none": 1, "mark": 2, "bias": 1, "class": CLASSES, "classes": CLASSES * CLASSES, "addressed": HUMAN * CLASSES, "person": HUMAN * CLASSES, "strong": COUNTS * CLASSES, "scene": HUMAN * COUNTS * 2, "usual": SHARES * 2, "formula": LEVELS + 1, "gram": GRAMS}


@dataclass(frozen=True)
class Background:
    """What the corpus tells without labels: its common words, and the levels of sentences that it repeats literally, as far as
    they hold a strong or a watched word."""

    words: frozenset[str] = frozenset()
    formulas: dict[int, int] = field(default_factory=dict)
    watched: frozenset[str] = frozenset()
    frequent: frozenset[str] = frozenset()  # of the words, those so common that no kind of passage could account for them


def watched_words(examples: list[tuple[str, str]]) -> frozenset[str]:
    """Forms that bad sentences of the judged passages hold and clean ones never."""
    labelled = label_examples(examples, Reader())
    return frozenset({t[0] for s, v in labelled if v for t in s} - {t[0] for s, v in labelled if not v for t in s} - {""})


def signing(form: str) -> str:
    """The form if it tells sentences apart (a longer word, a character of Chinese or Japanese), else nothing."""
    return form if form and (len(form) > 3 or _CJK.match(form)) and not any(c.isdigit() for c in form) else ""


def signed(kept: set[str]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(sorted(kept - {""})).encode(), digest_size=8).digest(), "big", signed=True)


def signature(forms: list[str]) -> int:
    """A number for the longer words of a sentence in any order, so that a lost article or a numeral makes no other sentence."""
    return signed({signing(f) for f in forms})


def level(n: np.ndarray, documents: int) -> np.ndarray:
    """Level of a sentence found in ``n`` documents; two standard errors are taken off, so that a few chance repeats in a small corpus are no formula."""
    share = np.maximum(n - 2 * np.sqrt(n), 0) / max(documents, 1)
    return np.clip(np.floor(np.log2(np.maximum(share, 1e-12) * 4096)) + 1, 0, LEVELS).astype(int)


def formula_ids(levels: np.ndarray, at: dict[str, int]) -> np.ndarray:
    """One feature for each level reached, so that weights of higher levels add to those of lower ones."""
    return np.where(np.arange(1, LEVELS + 1) <= levels[:, None], at["formula"] + np.arange(1, LEVELS + 1), 0)


def grams(form: str) -> list[int]:
    """Hashed letter trigrams of a form with its ends marked; none for characters of Chinese or Japanese."""
    if len(form) < 3 or _CJK.match(form):
        return []
    marked = f"^{form}$"
    return sorted({zlib.crc32(marked[i:i + 3].encode()) % GRAMS for i in range(len(marked) - 2)})


def strong_places(cls: np.ndarray, odd: np.ndarray) -> np.ndarray:
    return ((cls >= STRONG[0]) & (cls <= STRONG[1])) | (cls == BIGRAM) | odd


def scenes(cls: np.ndarray, odd: np.ndarray, digits: np.ndarray, usual: np.ndarray, worded: np.ndarray, first: np.ndarray, at: dict[str, int]) -> np.ndarray:
    """Features (rows: places) that depend on the whole sentence; ``first`` are the sentences' first places."""
    if not len(cls):
        return np.zeros((0, 5), np.int64)
    size = np.diff(np.append(first, len(cls)))
    strong = strong_places(cls, odd)
    add = lambda x: np.repeat(np.add.reduceat(x.astype(np.int64), first), size)
    addressed, person, n = np.minimum(add(cls == ADDRESS), 1), np.minimum(add(cls == PERSON), 1), np.minimum(add(strong), COUNTS - 1)
    share = np.minimum((add(usual & worded) * SHARES) // np.maximum(add(worded), 1), SHARES - 1)
    human = np.maximum(addressed, person)
    return np.stack([
        at["addressed"] + addressed * CLASSES + cls, at["person"] + person * CLASSES + cls, at["strong"] + n * CLASSES + cls,
        at["scene"] + (human * COUNTS + n) * 2 + np.minimum(add(digits), 1), at["usual"] + share * 2 + strong,
    ], 1)


def tokenize(text: str) -> list[str]:
    for whole, points, starts in chunks(pa.array([text])):
        begin = token_starts(points, starts)
        return [whole[a:b] for a, b in zip(begin, np.append(begin[1:], len(points)))]
    return []


def _sentences(tokens: list[tuple]) -> list[list[int]]:
    out, cur = [], []
    for i, t in enumerate(tokens):
        cur.append(i)
        if t[4]:
            out.append(cur)
            cur = []
    return [*out, cur] if cur else out


def label_examples(examples: list[tuple[str, str]], reader: Reader, rounds: int = 3) -> list[tuple[list[tuple], int]]:
    """Labelled sentences: of bad passages those whose words side with bad ones, all others clean. Background words side with none."""
    state = {s: i for i, s in enumerate(STATES)}
    items = []
    for snippet, verdict in examples:
        if snippet and verdict and verdict.strip().lower() in state:
            tokens = [reader.read(t) for t in tokenize(snippet)]
            items.append((state[verdict.strip().lower()], [[tokens[i] for i in s] for s in _sentences(tokens)]))
    good, bad = Counter(), Counter()
    for v, sents in items:
        for s in sents:
            if v == 0:
                good.update({t[0] for t in s})
            elif len(sents) == 1:
                bad.update({t[0] for t in s})
    for _ in range(rounds):
        total = np.log((sum(bad.values()) + 1) / (sum(good.values()) + 1))
        odds = lambda w, good=good, bad=bad, total=total: np.log((bad[w] + 0.3) / (good[w] + 0.3)) - total
        labelled, nbad, ngood = [], Counter(), Counter()
        for v, sents in items:
            marks = [np.mean([min(odds(t[0]), 0) if t[3] else odds(t[0]) for t in s] or [0]) for s in sents]
            top = int(np.argmax(marks)) if marks else -1
            for k, s in enumerate(sents):
                is_bad = v > 0 and (marks[k] > 0.4 or k == top)
                labelled.append((s, v if is_bad else 0))
                (nbad if is_bad else ngood).update({t[0] for t in s})
        good, bad = ngood, nbad
    return labelled


def train(examples: list[tuple[str, str]], corpus: Background = Background(), rounds: int = 150, rate: float = 0.08, seed: int = 3, word_drop: float = 0.6, gram_decay: float = 0.1) -> Model | None:
    """Maximises the chain likelihood with Adam; words and pairs are dropped at random so that classes learn to stand in."""
    background = corpus.words
    reader = Reader(background=background)
    labelled = label_examples(examples, reader)
    if not any(v for _, v in labelled) or all(v for _, v in labelled):
        return None
    # words that only bad sentences hold are read through odd spellings as well
    good = {t[0] for s, v in labelled if v == 0 for t in s}
    often = Counter(t[0] for s, v in labelled if v for t in s)
    background -= {w for w in often if w not in good} - corpus.frequent  # repeats alone do not clear a word
    reader.background = background
    for w, n in often.items():
        if w not in good and n > 1 and len(w) > 3 and w.isalpha() and not _CJK.match(w):
            reader.bad.setdefault(w, 0)
    reader.index()
    labelled = label_examples(examples, reader)
    # passages run together without a full stop: join every bad sentence with a clean one as well
    rng = np.random.default_rng(seed)
    clean = [s for s, v in labelled if v == 0 and len(s) > 4]
    found = {id(s): corpus.formulas.get(signature([t[0] for t in s]), 0) for s, _ in labelled}
    chains = [(s, [v] * len(s), [found[id(s)]] * len(s)) for s, v in labelled if s]
    for s, v in list(labelled):
        if v and clean:
            other = clean[rng.integers(len(clean))]
            chains.append(([*s, *other], [v] * len(s) + [0] * len(other), [0] * (len(s) + len(other))) if rng.random() < 0.5 else ([*other, *s], [0] * len(other) + [v] * len(s), [0] * (len(s) + len(other))))
    count = Counter(t[0] for s, *_ in chains for t in s)
    count.pop("", None)
    words = {w: i for i, (w, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0])), 1)}
    chains.sort(key=lambda c: len(c[0]))
    sizes = np.array([len(s) for s, *_ in chains])
    first = np.cumsum(sizes) - sizes
    flat = [t for s, *_ in chains for t in s]
    gold, levels = np.array([g for _, y, _ in chains for g in y]), np.array([f for *_, f in chains for f in f])
    word = np.array([words.get(t[0], 0) for t in flat], np.int64)
    cls = np.array([t[1] for t in flat], np.int64)
    starts = np.zeros(len(flat), bool)
    starts[first] = True
    for j in range(1, len(flat)):
        if not starts[j] and flat[j - 1][0] + flat[j][0] in reader.pairs:
            cls[j] = BIGRAM
    left = np.where(starts, 0, np.concatenate([[0], word[:-1]]))
    base = len(words) + 1
    key = np.where((left > 0) & (word > 0), left * base + word, -1)
    kept = np.unique(key[key >= 0])
    at, end = {}, 0
    for name, n in {**BLOCKS, "word": base, "pair": len(kept)}.items():
        at[name], end = end, end + n
    model = Model(reader, words, kept, base, at, np.zeros((end, len(STATES))), np.zeros((len(STATES),) * 2), corpus.formulas, corpus.watched)
    own = [grams(f) for f in ["", *words]]  # per word number
    spelt_word = np.repeat(np.arange(base), [len(o) for o in own])
    spelt = at["gram"] + np.array([g for o in own for g in o], np.int64)
    pair = np.where(key >= 0, at["pair"] + np.searchsorted(kept, np.maximum(key, 0)), 0)
    both = at["classes"] + np.where(starts, 0, np.concatenate([[0], cls[:-1]])) * CLASSES + cls
    marks = np.array([[t[2], t[3]] for t in flat], bool).reshape(-1, 2)
    digits, worded = np.array([any(c.isdigit() for c in t[0]) or not t[0] for t in flat]), np.array([bool(t[0]) for t in flat])
    rest = np.concatenate([
        np.full((len(flat), 1), at["bias"]), np.where(marks, at["mark"] + np.arange(2), 0), (at["class"] + cls)[:, None], both[:, None], scenes(cls, marks[:, 0], digits, marks[:, 1], worded, first, at),
        formula_ids(levels, at),
    ], 1)
    decay = np.zeros((end, 1))
    for name, d in {"none": 1.0, "word": 0.02, "pair": 0.06, "class": 0.01, "classes": 0.03, "mark": 0.02, "bias": 0.01, "addressed": 0.02, "person": 0.02, "strong": 0.02, "scene": 0.02, "usual": 0.02, "formula": 0.004, "gram": gram_decay}.items():
        decay[at[name]:at[name] + {**BLOCKS, "word": base, "pair": len(kept)}[name]] = d
    prior_w, prior_t = np.zeros_like(model.w), np.eye(len(STATES))
    prior_w[at["mark"] + 1, 0] = prior_w[at["bias"], 0] = 1.0
    w, trans = prior_w.copy(), prior_t.copy()
    m1, m2, t1, t2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)
    blocks = [(a, min(a + 256, len(chains))) for a in range(0, len(chains), 256)]
    shown, which = np.unique(rest, axis=0, return_inverse=True)  # many places show the same
    which = which.reshape(-1)
    states = range(len(STATES))
    total = lambda at_, d_, n: np.stack([np.bincount(at_, d_[:, k], n) for k in states], 1)
    kept_rounds, mean_w, mean_t = 0, w.copy(), trans.copy()
    for step in range(1, rounds + 1):
        seen = rng.random(len(flat)) >= word_drop
        linked_too = seen & (rng.random(len(flat)) < 0.5)
        read_too = seen | (rng.random(len(flat)) < 0.3)
        letters = total(spelt_word, w[spelt], base)
        emit = w[shown].sum(1)[which] + np.where(seen, 1.0, 0.0)[:, None] * w[at["word"] + word] + np.where(linked_too, 1.0, 0.0)[:, None] * w[pair] + np.where(read_too, 1.0, 0.0)[:, None] * letters[word]
        d, tg = np.zeros_like(emit), np.zeros_like(trans)
        for a, b in blocks:  # chains of like length
            long = int(sizes[b - 1])
            pos = first[a:b, None] + np.arange(long)
            mask = np.arange(long) < sizes[a:b, None]
            pos = np.minimum(pos, len(flat) - 1)
            p, edge = forward_backward(emit[pos], mask, trans, edges=True)
            d[pos[mask]] = np.eye(len(STATES))[gold[pos[mask]]] - p[mask]
            tg -= edge
        linked = ~starts
        linked[0] = False
        np.add.at(tg, (gold[np.flatnonzero(linked) - 1], gold[linked]), 1.0)
        g = total(shown.ravel(), np.repeat(total(which, d, len(shown)), shown.shape[1], axis=0), end)
        g[at["word"]:at["word"] + base] += total(word[seen], d[seen], base)
        g += total(pair[linked_too], d[linked_too], end)
        np.add.at(g, spelt, total(word[read_too], d[read_too], base)[spelt_word])
        g -= decay * 8 * (w - prior_w)
        g[0] = g[at["word"]] = 0.0
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
        tg -= 0.08 * (trans - prior_t)
        t1, t2 = 0.9 * t1 + 0.1 * tg, 0.99 * t2 + 0.01 * tg * tg
        trans += rate * (t1 / (1 - 0.9**step)) / (np.sqrt(t2 / (1 - 0.99**step)) + 1e-6)
        if 3 * step > rounds:  # the mean of the later rounds evens out what was dropped at random
            kept_rounds += 1
            mean_w += (w - mean_w) / kept_rounds
            mean_t += (trans - mean_t) / kept_rounds
    model.w, model.trans = mean_w, mean_t
    return model


def forward_backward(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray, edges: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of padded chains (chain, position, state), in scaled probabilities, and summed edge marginals on request."""
    n, length, k = emit.shape
    e = np.exp(emit - emit.max(2, keepdims=True))
    t = np.exp(trans)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for i in range(1, length):
        a = (alpha[:, i - 1] @ t) * e[:, i]
        alpha[:, i] = np.where(mask[:, i, None], a / a.sum(1, keepdims=True), alpha[:, i - 1])
    for i in range(length - 2, -1, -1):
        b = (e[:, i + 1] * beta[:, i + 1]) @ t.T
        beta[:, i] = np.where(mask[:, i + 1, None], b / b.sum(1, keepdims=True), 1.0)
    p = alpha * beta
    p /= p.sum(2, keepdims=True)
    if not edges:
        return p, None
    left, right = alpha[:, :-1], e[:, 1:] * beta[:, 1:]
    scale = np.where(mask[:, 1:], 1.0 / ((left @ t) * right).sum(2), 0.0)
    return p, t * ((left * scale[..., None]).reshape(-1, k).T @ right.reshape(-1, k))


class Tagger:
    """Scores batches of texts; what a piece contributes is worked out once per distinct piece."""

    def __init__(self, model: Model):
        self.model = model
        self.bigrams = bigram_keys(model.reader.pairs)
        self.table = PieceTable(self._learn, self._forget)
        self._forget()

    def _forget(self) -> None:
        self.emit = np.zeros((0, len(STATES)))
        self.signing: list[str] = []
        self.word, self.cls = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ends, self.odd, self.usual, self.digits, self.worded, self.watched = (np.zeros(0, bool) for _ in range(6))

    def _learn(self, pieces: list[str]) -> None:
        m = self.model
        got = [m.reader.read(p) for p in pieces]
        word = np.array([m.words.get(g[0], 0) for g in got], np.int64)
        marks = np.array([[g[2], g[3]] for g in got], float).reshape(-1, 2)
        spelt = np.array([m.w[[m.at["gram"] + x for x in grams(g[0])]].sum(0) for g in got]).reshape(-1, len(STATES))
        emit = m.w[m.at["word"] + word] + marks @ m.w[m.at["mark"]:m.at["mark"] + 2] + m.w[m.at["bias"]] + spelt
        self.emit = np.concatenate([self.emit, emit])
        self.signing += [signing(g[0]) for g in got]
        self.word, self.cls = np.concatenate([self.word, word]), np.concatenate([self.cls, np.array([g[1] for g in got], np.int64)])
        flags = {"ends": [g[4] for g in got], "odd": [g[2] for g in got], "usual": [g[3] for g in got], "digits": [any(c.isdigit() for c in g[0]) or not g[0] for g in got], "worded": [bool(g[0]) for g in got], "watched": [g[0] in m.watched for g in got]}
        for name, x in flags.items():
            setattr(self, name, np.concatenate([getattr(self, name), np.array(x, bool)]))

    def spans(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, float]]:
        """(text number, start, end, state, score) of each bad span; ends exclusive, in code points."""
        for base, found, _, _ in self.judge(texts):
            yield from ((base + o, *rest) for o, *rest in found)

    def judge(self, texts: pa.Array) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
        """Per stretch of texts: number of its first text, its spans, and each text's score and worst state."""
        base = 0
        m = self.model
        for whole, points, starts in chunks(texts):
            begin = token_starts(points, starts)
            number = self.table.numbers(whole, points, begin)
            count = len(starts) - 1
            found: list[tuple] = []
            score, state = np.zeros(count), np.zeros(count, np.int64)
            if len(number):
                owner = np.searchsorted(starts, begin, "right") - 1
                cut = np.ones(len(number), bool)
                cut[1:] = self.ends[number[:-1]] | (owner[1:] != owner[:-1])
                first = np.flatnonzero(cut)
                size = np.diff(np.append(first, len(number)))
                cls = self.cls[number]
                cls[ends_bigram(points, begin, cut, self.bigrams)] = BIGRAM
                emit = self.emit[number] + m.w[m.at["class"] + cls]
                for ids in scenes(cls, self.odd[number], self.digits[number], self.usual[number], self.worded[number], first, m.at).T:
                    emit += m.w[ids]
                for k in np.flatnonzero(np.bitwise_or.reduceat(strong_places(cls, self.odd[number]) | self.watched[number], first)) if m.formulas else ():
                    a, z = first[k], first[k] + size[k]
                    high = m.formulas.get(signed(set(map(self.signing.__getitem__, number[a:z].tolist()))), 0)
                    if high:
                        emit[a:z] += m.w[m.at["formula"] + 1:m.at["formula"] + 1 + high].sum(0)
                follows = ~cut
                follows[0] = False
                before = np.where(follows, np.roll(cls, 1), 0)
                emit += m.w[m.at["classes"] + before * CLASSES + cls]
                pair = np.where(follows, m.pair_ids(self.word[number]), 0)
                known = np.flatnonzero(pair)
                emit[known] += m.w[pair[known]]
                for at, best, kind, runs in self._decode(emit, first, size):
                    o = owner[at]
                    order = np.argsort(best, kind="stable")
                    better = best[order] > score[o[order]]
                    score[o[order][better]], state[o[order][better]] = best[order][better], kind[order][better]
                    for a, z, k, mean in runs:
                        i = owner[a]
                        start, stop = begin[a], min(begin[z] if z < len(begin) else len(points), starts[i + 1])
                        text = whole[start:stop]
                        found.append((int(i), int(start - starts[i]), int(stop - starts[i]) - len(text) + len(text.rstrip()), k, mean))
            yield base, found, score, state
            base += count

    def _decode(self, emit: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
        """Per block of chains: first places, score, its state, and the spans."""
        pieces = [(a + s, min(CHAIN, z - s)) for a, z in zip(first.tolist(), size.tolist()) for s in range(0, max(z - CHAIN // 4, 1), CHAIN * 3 // 4)]
        pieces.sort(key=lambda x: x[1])
        for at in range(0, len(pieces), 512):
            part = pieces[at:at + 512]
            start, length = np.array([p[0] for p in part]), np.array([p[1] for p in part])
            wide = int(length.max())
            pos = start[:, None] + np.arange(wide)
            mask = np.arange(wide) < length[:, None]
            p, _ = forward_backward(emit[np.minimum(pos, len(emit) - 1)], mask, self.model.trans)
            bad = np.where(mask, 1 - p[..., 0], 0)
            padded = np.pad(bad, ((0, 0), (0, 2)))
            near = (padded[:, :-2] + padded[:, 1:-1] + padded[:, 2:]) / 3
            top = near.argmax(1)
            i = np.arange(len(part))
            around = np.minimum(top[:, None] + np.arange(3), wide - 1)
            kind = np.where(mask[i[:, None], around][..., None], p[i[:, None], around, 1:], 0).sum(1).argmax(1) + 1
            best, runs = np.minimum(near[i, top], 0.499999), []
            for r in np.flatnonzero(bad.max(1) > 0.5):
                run = np.concatenate([[False], bad[r] > 0.5, [False]])
                edge = np.flatnonzero(run[1:] != run[:-1])
                for a, b in zip(edge[::2], edge[1::2]):
                    mean = float(bad[r, a:b].sum() / max(3, b - a))
                    if mean >= 0.5:
                        runs.append((int(pos[r, a]), int(pos[r, b - 1]) + 1, int(p[r, a:b, 1:].sum(0).argmax()) + 1, mean))
                        if mean > best[r]:
                            best[r], kind[r] = mean, runs[-1][2]
            yield start, best, kind, runs


class Counting:
    """Counts, for every form, the places it has and those in whose sentence there is another seed word."""

    def __init__(self, watched: frozenset[str] = frozenset()) -> None:
        self.reader, self.watch = Reader(), watched
        self.bigrams = bigram_keys(self.reader.pairs)
        self.table = PieceTable(self._learn, self._forget)
        self.total: Counter = Counter()
        self.seeded: Counter = Counter()
        self.repeated: Counter = Counter()
        self.documents = 0
        self._clear()

    def _clear(self) -> None:
        self.forms: list[str] = []
        self.signing: list[str] = []
        self.ends, self.seed, self.watched = np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, bool)
        self.n, self.bad, self.form = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids: dict[str, int] = {}

    def _forget(self) -> None:
        self.settle()
        self._clear()

    def settle(self) -> None:
        """Moves the counts of pieces to their forms."""
        for f, n, b in zip(self.forms, self.n.tolist(), self.bad.tolist()):
            if n and f:
                self.total[f] += n
                self.seeded[f] += b
        self.n[:] = 0
        self.bad[:] = 0

    def _learn(self, pieces: list[str]) -> None:
        got = [self.reader.read(p) for p in pieces]
        self.forms += [g[0] for g in got]
        self.signing += [signing(g[0]) for g in got]
        self.ends = np.concatenate([self.ends, np.array([g[4] for g in got], bool)])
        self.seed = np.concatenate([self.seed, np.array([STRONG[0] <= g[1] <= STRONG[1] or g[2] for g in got], bool)])
        self.form = np.concatenate([self.form, np.array([self.ids.setdefault(g[0], len(self.ids)) for g in got], np.int64)])
        self.watched = np.concatenate([self.watched, np.array([g[0] in self.watch for g in got], bool)])
        self.n, self.bad = (np.concatenate([x, np.zeros(len(got), np.int64)]) for x in (self.n, self.bad))

    def add(self, texts: pa.Array) -> None:
        for whole, points, starts in chunks(texts):
            begin = token_starts(points, starts)
            number = self.table.numbers(whole, points, begin)
            if not len(number):
                continue
            owner = np.searchsorted(starts, begin, "right") - 1
            cut = np.ones(len(number), bool)
            cut[1:] = self.ends[number[:-1]] | (owner[1:] != owner[:-1])
            pair = ends_bigram(points, begin, cut, self.bigrams)
            pair[:-1] |= pair[1:]  # both characters of a two-character word
            seed = self.seed[number] | pair
            sentence = np.cumsum(cut) - 1
            _, one = np.unique(sentence[seed] * np.int64(len(self.ids) + 1) + self.form[number[seed]], return_index=True)  # a form counts once a sentence
            others = np.bincount(sentence[seed][one], minlength=sentence[-1] + 1)[sentence] - seed  # no form is a seed of its own
            others[pair] = 1
            self.n += np.bincount(number, minlength=len(self.n))
            self.bad += np.bincount(number[others > 0], minlength=len(self.n))
            self.documents += len(starts) - 1
            first = np.flatnonzero(cut)
            stop = np.append(first[1:], len(number))
            for k, o in {(signed(set(map(self.signing.__getitem__, number[first[k]:stop[k]].tolist()))), owner[first[k]]) for k in np.flatnonzero(np.bitwise_or.reduceat(seed | self.watched[number], first))}:
                self.repeated[k] += 1  # once a document


def corpus_background(df: DataFrame, text: str = "text", watched: frozenset[str] = frozenset(), rate: float = 0.05, share: float = 1e-6, frequent: float = 1e-4) -> Background:
    """Common words: forms in at least ``share`` of all places of which less than ``rate`` share a sentence with a seed word
    other than themselves; those with a share of ``frequent`` stay common even if only bad examples hold them (their part of all
    text is too large for that). Repeated sentences: those with a seed or watched word, by the share of documents that hold them.

    Counted over all texts, added up per task and then by Spark. No more than 1 / ``share`` forms reach that share, and no
    more than 4096 times the seeded sentences of an average document reach the lowest level, so what the driver gets is bounded."""
    schema = "kind int, form string, hash long, n long, bad long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counting(watched)
        def out() -> pa.RecordBatch:
            c.settle()
            places = sum(c.total.values())
            rows = [(0, None, 0, places, c.documents), *((1, f, 0, n, c.seeded[f]) for f, n in c.total.items()), *((2, None, h, n, 0) for h, n in c.repeated.items())]
            kind, form, code, n, bad = zip(*rows)
            c.total.clear()
            c.seeded.clear()
            c.repeated.clear()
            c.documents = 0
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(form, pa.string()), pa.array(code, pa.int64()), pa.array(n, pa.int64()), pa.array(bad, pa.int64())], names=["kind", "form", "hash", "n", "bad"])
        for b in batches:
            c.add(b.column(0))
            if len(c.total) + len(c.repeated) > 500_000:
                yield out()
        yield out()

    counted = df.select(text).mapInArrow(run, schema).groupBy("kind", "form", "hash").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).persist()
    whole = counted.where("kind = 0").first()
    places, documents = (whole["n"], whole["bad"]) if whole else (0, 0)
    words = counted.where((F.col("kind") == 1) & (F.col("n") >= share * places) & (F.col("bad") < rate * F.col("n"))).select("form", "n").collect()
    often = counted.where((F.col("kind") == 2) & (F.col("n") >= documents / 4096)).select("hash", "n").collect()
    counted.unpersist()
    levels = level(np.array([r["n"] for r in often], float), documents)
    return Background(frozenset(r["form"] for r in words), {r["hash"]: int(v) for r, v in zip(often, levels) if v}, watched, frozenset(r["form"] for r in words if r["n"] >= frequent * places))


_models: dict[tuple, Model | None] = {}


def judged(examples: DataFrame) -> list[tuple[str, str]]:
    """At most ``MAX_EXAMPLES`` judged passages, by number."""
    return [(r[0], r[1]) for r in examples.select("snippet", "verdict").orderBy("example_id").limit(MAX_EXAMPLES).collect()]


def fit_model(examples: DataFrame, documents: DataFrame, text: str = "text") -> Model | None:
    """The model of the judged passages before the background of all documents; the last one is kept and used again for the same input."""
    rows = judged(examples)
    corpus = corpus_background(documents, text, watched_words(rows))
    key = (tuple(rows), corpus.words, frozenset(corpus.formulas.items()))
    if key not in _models:
        _models.clear()
        _models[key] = train(rows, corpus)
    return _models[key]


_taggers: dict[str, Tagger] = {}


def score_texts(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """``key``, score, worst class, and the spans (start, end, label, score) of every text.

    A span is a run of words that are more likely bad than not; spans shorter than three words count as three, so a single word
    never decides. The score is the best span's mean marginal. Without a span of 0.5 or more it is the best mean of three
    neighbouring words, below 0.5, so that every text can be ranked for review.
    The model (a few MB at most, by the bound on examples) is broadcast."""
    import uuid

    shared, name = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    kinds = dict(df.dtypes)
    schema = f"{key} {kinds[key]}, " + "".join(f"{e} {kinds[e]}, " for e in extra) + "score double, label string, spans array<struct<start:int,end:int,label:string,score:double>>"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _taggers:
            _taggers.clear()
            _taggers[name] = Tagger(shared.value) if shared.value else None
        tagger = _taggers[name]
        for b in batches:
            found: list[list] = [[] for _ in range(b.num_rows)]
            best, state = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for base, spans, score, kind in tagger.judge(b.column(1)) if tagger else ():
                best[base:base + len(score)], state[base:base + len(score)] = score, kind
                for o, start, end, k, mean in spans:
                    if not any(x["start"] <= start and end <= x["end"] for x in found[base + o]):
                        found[base + o].append({"start": start, "end": end, "label": STATES[k], "score": round(mean, 6)})
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(b.column(2 + i) for i in range(len(extra))), pa.array(np.round(best, 6)), pa.array([STATES[k] if x >= 0.5 else None for x, k in zip(best, state)], pa.string()),
                 pa.array([sorted(f, key=lambda x: x["start"]) for f in found], span)],
                names=[key, *extra, "score", "label", "spans"],
            )

    return df.select(key, text, *extra).mapInArrow(run, schema)


def source_rates(scored: DataFrame, source: str = "source", threshold: float = 0.5) -> DataFrame:
    bad = F.col("score") >= threshold
    return scored.groupBy(source).agg(
        F.count("*").alias("n_documents"), F.count_if(bad).alias("n_flagged"), F.avg(bad.cast("double")).alias("flagged_share"), F.avg("score").alias("mean_score"),
        *[F.count_if(bad & (F.col("label") == s)).alias(f"n_{s}") for s in STATES[1:]],
    )
