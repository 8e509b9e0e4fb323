"""Dense features of whole texts, computed on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidewater.llm.common import mix64, span_hashes, text_chunks, word_spans

QUALITY = (
    "log_bytes", "log_words", "mean_word", "long_words", "one_letter", "upper", "digits", "symbols", "stops", "commas",
    "marks", "bars", "wide", "spaces", "lines", "mean_line", "same_lines", "same_lines_bytes", "distinct_words", "top_word",
    "distinct_fives", "all_caps_words", "mixed_words", "capital_words", "line_ends", "brackets", "quotes", "entropy",
)

# everyday insults and swear words; single words, lower-case
INSULTS = (
    "arsehole asshole bastard bitch bollocks brainless bullshit clown coward crap creep cretin cunt damn degenerate despicable dickhead disgusting "
    "douche dumb dumbass dunce fool freak fuck fucking garbage gross hate hateful idiot idiotic idiots ignorant imbecile incompetent jackass jerk "
    "kill liar loathsome loser losers lowlife lunatic maggot moron moronic morons nasty nobody parasite pathetic pig pigs prick psycho rat "
    "repulsive retard rotten rubbish scum scumbag shit shitty shut sick slut stupid stupidity subhuman suck sucks terrible thug trash traitor twat ugly "
    "useless vermin vile wanker weirdo whore worm worthless wretch imbécile connard salope idiota estúpido basura imbécil dumm dumme idioten abschaum"
).split()
SECOND = "you your yours yourself u ur yall du dich dir dein deine ihr euch tu te toi vous votre usted ustedes tus".split()
COMMON = ("log_words", "second", "capitals", "shouted_words", "exclaims", "questions", "punctuation", "odd_marks", "mixed_words", "stretched")
BLOCK = ("insults", "insults_density", "kinds", "plain_insults", "hidden_insults", "second_near", "sentence_share")
TOXICITY = COMMON + BLOCK
PREFIXES = (3, 4, 5, 6, 8)  # bytes of a word by which induced insults are known, besides whole words
NEAR = 6  # words


def _lengths(n: int, where: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the sorted positions lie in each text."""
    return np.diff(np.searchsorted(where, at)).astype(float)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    return np.unique(span_hashes(data, ends - np.array([len(w) for w in raw]), ends))


def _class(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(bytes(chars), np.uint8)] = True
    return out


_UPPER, _LOWER, _DIGIT, _WIDE = _class(range(65, 91)), _class(range(97, 123)), _class(range(48, 58)), _class(range(128, 256))
_STOP, _COMMA, _MARK, _BAR = _class(b"."), _class(b",;:"), _class(b"!?"), _class(b"|")
_SYMBOL, _BRACKET, _QUOTE, _SPACE = _class(b"#$%&*+/<=>@\\^_`~"), _class(b"()[]{}"), _class(b"\"'"), _class(b" \t\n\v\f\r")
_LETTER = _UPPER | _LOWER | _WIDE
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LOOK_ALIKE = _class(b"@$!|")
_LEET = _FOLD.copy()
for _mark, _letter in zip(b"0134578@$!|", b"oieastbasil", strict=True):
    _LEET[_mark] = _letter


def quality_features(column: pa.Array) -> Iterator[np.ndarray]:
    """Rows of QUALITY for every text; a text without words gets zeros where nothing can be counted."""
    for _, data, at in text_chunks(column):
        n = np.diff(at).astype(float)
        starts, ends, owner = word_spans(data, at)
        words = np.bincount(owner, minlength=len(n)).astype(float)
        count = lambda table: _lengths(len(n), np.flatnonzero(table[data]), at)  # noqa: E731, B023
        per_word = lambda values: np.bincount(owner, values, minlength=len(n))  # noqa: E731, B023
        within = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[np.stack([starts, ends])], axis=0)[0]  # noqa: E731, B023
        length = (ends - starts).astype(float)
        upper, lower, letters = within(_UPPER), within(_LOWER | _WIDE), within(_LETTER)
        marks = length - letters
        hashed = span_hashes(_FOLD[data], starts, ends)
        bounds = np.searchsorted(owner, np.arange(len(n) + 1))
        lines_at = np.flatnonzero(data == 10)
        with np.errstate(over="ignore"):
            fives = mix64(sum((hashed[j : len(hashed) - 4 + j] * np.uint64(2 * j + 0x9E3779B97F4A7C15) for j in range(5)), np.zeros(max(0, len(hashed) - 4), np.uint64)))
        extra = np.zeros((len(n), 8))
        ends_well = np.zeros(len(data) + 1, bool)
        ends_well[1:] = (_STOP | _MARK)[data]
        for i in range(len(n)):
            a, b = bounds[i], bounds[i + 1]
            if a == b:
                continue
            _, times = np.unique(hashed[a:b], return_counts=True)
            share = times / (b - a)
            extra[i, 0], extra[i, 1], extra[i, 7] = len(times) / (b - a), share.max(), -(share * np.log(share)).sum() / np.log(b - a + 1)
            extra[i, 2] = len(np.unique(fives[a : b - 4])) / (b - a - 4) if b - a > 4 else 1
            cut = np.concatenate([[at[i]], lines_at[np.searchsorted(lines_at, at[i]) : np.searchsorted(lines_at, at[i + 1])] + 1, [at[i + 1] + 1]])
            first, last = cut[:-1], np.minimum(cut[1:] - 1, at[i + 1])
            solid = last > first
            first, last = first[solid], last[solid]
            if len(first):
                _, place, times = np.unique(span_hashes(data[at[i] : at[i + 1]], first - at[i], last - at[i]), return_index=True, return_counts=True)
                extra[i, 3], extra[i, 4] = len(first), 1 - len(times) / len(first)
                extra[i, 5] = 1 - (last - first)[place].sum() / (last - first).sum()
                extra[i, 6] = ends_well[last].mean()
        yield np.stack(
            [
                np.log1p(n), np.log1p(words), _ratio(per_word(length), words), _ratio(per_word(length > 12), words), _ratio(per_word(length == 1), words),
                _ratio(count(_UPPER), n), _ratio(count(_DIGIT), n), _ratio(count(_SYMBOL), n), _ratio(count(_STOP), words), _ratio(count(_COMMA), words),
                _ratio(count(_MARK), words), _ratio(count(_BAR), words), _ratio(count(_WIDE), n), _ratio(count(_SPACE), n), np.log1p(extra[:, 3]),
                np.log1p(_ratio(n, extra[:, 3])), extra[:, 4], extra[:, 5], extra[:, 0], extra[:, 1], extra[:, 2],
                _ratio(per_word((upper > 1) & (lower == 0)), words), _ratio(per_word((letters > 0) & (marks > 1)), words), _ratio(per_word((upper == 1) & (lower > 0)), words),
                extra[:, 6], _ratio(count(_BRACKET), n), _ratio(count(_QUOTE), n), extra[:, 7],
            ],
            axis=1,
        )


def _letter_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of runs of letters."""
    letter = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    starts = np.flatnonzero(letter & (~before | edge[:-1]))
    ends = np.flatnonzero(letter & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def _stems(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, hashes): whole words, and the prefixes of those that are longer; prefixes hash apart from whole words."""
    yield np.arange(len(starts)), span_hashes(data, starts, ends)
    for n in PREFIXES:
        longer = np.flatnonzero(ends - starts > n)
        yield longer, span_hashes(data, starts[longer], starts[longer] + n) ^ np.uint64(n)


def stem_counts(column: pa.Array, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all stems in the texts, and in how many texts of each group every one occurs."""
    found, first = [], 0
    for _, data, at in text_chunks(column):
        low = _FOLD[data]
        starts, ends, owner = _letter_words(low, at)
        for words, hashes in _stems(low, starts, ends):
            pairs = np.empty(len(words), [("h", np.uint64), ("t", np.int64)])
            pairs["h"], pairs["t"] = hashes, owner[words] + first
            found.append(np.unique(pairs))
        first += len(at) - 1
    pairs = np.concatenate(found) if found else np.empty(0, [("h", np.uint64), ("t", np.int64)])
    hashes, slot = np.unique(pairs["h"], return_inverse=True)
    counts = np.bincount(slot * groups + group[pairs["t"]], minlength=len(hashes) * groups).reshape(-1, groups)
    return hashes, counts


def lexicon(induced: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and masks: bit v is set for the words of INSULTS and those induced for variant v."""
    fixed = _hash_words(INSULTS)
    hashes = np.unique(np.concatenate([fixed, *induced]))
    masks = np.where(np.isin(hashes, fixed), (1 << len(induced)) - 1, 0)
    for v, own in enumerate(induced):
        masks |= np.isin(hashes, own).astype(np.int64) << v
    return hashes, masks


def toxicity_features(column: pa.Array, known: tuple[np.ndarray, np.ndarray], variants: int) -> Iterator[np.ndarray]:
    """COMMON and then BLOCK for each variant of the lexicon, for every text.

    Insults are sought as they stand, and with look-alike digits and marks read as letters, dots and dashes between
    letters left out and stretched letters shortened.
    """
    hashes, masks = known
    second = _hash_words(SECOND)

    def mask_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mask of every word, and the hash that gave it."""
        mask, kind = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.uint64)
        for words, h in _stems(data, starts, ends):
            slot = np.searchsorted(hashes, h)
            slot[slot == len(hashes)] = 0
            hit = np.flatnonzero(hashes[slot] == h)
            mask[words[hit]] |= masks[slot[hit]]
            kind[words[hit]] = h[hit]
        return mask, kind

    for _, data, at in text_chunks(column):
        n = len(at) - 1
        starts, ends, owner = word_spans(data, at)
        words = np.bincount(owner, minlength=n).astype(float)
        low = _FOLD[data]
        s, e, text = _letter_words(low, at)
        plain, plain_kind = mask_of(low, s, e)
        you = np.flatnonzero(np.isin(span_hashes(low, s, e), second) if len(s) else np.zeros(0, bool))
        letter = _LETTER[data]
        # hidden words: look-alikes read as letters, joiners dropped, three or more equal letters shortened to one
        solid = letter | _DIGIT[data]
        before_word = np.zeros(len(data), bool)
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        before_word[:-1] = solid[1:] & ~edge[1:-1]
        leet = np.where(_LOOK_ALIKE[data] & ~before_word, data, _LEET[data])  # a mark that ends a word is no letter
        same = np.zeros(len(data), bool)
        same[2:] = (leet[2:] == leet[1:-1]) & (leet[1:-1] == leet[:-2]) & ~edge[2:-1] & ~edge[1:-2]
        run = same.copy()
        run[:-1] |= same[1:]
        keep = ~run & _LETTER[leet]
        sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[np.stack([starts, ends])], axis=0)[0]  # noqa: E731, B023
        has_letter, upper = sums(letter), sums(_UPPER[data])
        inner = letter | np.isin(data, np.frombuffer(b".,;:!?\"'()", np.uint8))  # what ordinary words are made of
        odd = np.flatnonzero((sums(~inner) + sums(run) + sums(_LOOK_ALIKE[data] & before_word) > 0) & (has_letter > 0) & (ends - starts < 64))
        dotted = np.flatnonzero((sums(~letter) >= 2) & (has_letter >= 3) & (ends - starts < 64))
        odd = np.union1d(odd, dotted)
        kept = np.flatnonzero(keep)
        hidden, hidden_kind = mask_of(leet[kept], np.searchsorted(kept, starts[odd]), np.searchsorted(kept, ends[odd]))
        hidden_text = owner[odd]
        # a word that holds a plain insult isn't a hidden one too
        holds = np.concatenate([[0], np.cumsum(plain > 0)])
        hidden[holds[np.searchsorted(s, ends[odd])] > holds[np.searchsorted(s, starts[odd])]] = 0
        count = lambda table: _lengths(n, np.flatnonzero(table[data]), at)  # noqa: E731, B023
        per_text = lambda owners: np.bincount(owners, minlength=n).astype(float)  # noqa: E731, B023
        sentences = count(_STOP | _MARK)
        columns = [
            np.log1p(words), _ratio(per_text(text[you]), words), _ratio(count(_UPPER), count(_LETTER)), _ratio(per_text(owner[(upper > 1) & (upper == has_letter)]), words),
            _ratio(count(_class(b"!")), words), _ratio(count(_class(b"?")), words), _ratio(count(_STOP | _COMMA | _MARK), words), _ratio(count(_SYMBOL), np.diff(at)),
            _ratio(per_text(owner[odd]), words), _ratio(per_text(np.searchsorted(at, np.flatnonzero(same & letter), "right") - 1), np.diff(at)),
        ]
        for v in range(variants):
            where, other = np.flatnonzero(plain >> v & 1), np.flatnonzero(hidden >> v & 1)
            n_plain, n_hidden = per_text(text[where]), per_text(hidden_text[other])
            pairs = np.empty(len(where) + len(other), [("t", np.int64), ("h", np.uint64)])
            pairs["t"], pairs["h"] = np.concatenate([text[where], hidden_text[other]]), np.concatenate([plain_kind[where], hidden_kind[other]])
            near = np.zeros(len(you), bool)
            for side in (-1, 0) if len(where) else ():  # second person within NEAR words of an insult
                spot = np.searchsorted(where, you) + side
                beside = where[np.clip(spot, 0, len(where) - 1)]
                near |= (spot >= 0) & (spot < len(where)) & (np.abs(beside - you) <= NEAR) & (text[beside] == text[you])
            both = n_plain + n_hidden
            columns += [both, _ratio(100 * both, words), per_text(np.unique(pairs)["t"]), n_plain, n_hidden, per_text(text[you[near]]), _ratio(both, sentences)]
        yield np.stack(columns, axis=1)
