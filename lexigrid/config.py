"""Settings of the three workloads, read from a configuration text with sections, with their modes as enumerations."""

from __future__ import annotations

import dataclasses
import enum
import json
import re
from dataclasses import dataclass, field


class Extract(enum.Enum):
    Phrase = "Phrase"
    Rule = "Rule"


class Direction(enum.Enum):
    C2E = "C2E"
    E2C = "E2C"


class Constraint(enum.Enum):
    WellFormed = "wellformed"
    Relaxed = "relaxed"
    ANY = "any"


class Tags(enum.Enum):
    NONE = "None"
    AllPossible = "AllPossible"
    Frame = "Frame"
    BestOne = "BestOne"


class Dependencies(enum.Enum):
    NONE = "None"
    DepString = "DepString"


class Syntax(enum.Enum):
    NONE = "None"
    S2D = "S2D"


@dataclass
class Translation:
    inputDir: str = ""
    rootDir: str = ""
    optType: Extract = Extract.Phrase
    maxc: int = 5
    maxe: int = 5
    maxSpan: int = 10
    maxInitPhraseLength: int = 10
    maxSlots: int = 2
    minCWords: int = 1
    minEWords: int = 1
    maxCSymbols: int = 5
    maxESymbols: int = 5
    minWordsInSlot: int = 1
    allowConsecutive: bool = False
    allowAllUnaligned: bool = False
    withNullOption: bool = False
    allowBoundaryUnaligned: bool = True
    cutoff: int = 0
    direction: Direction = Direction.C2E
    smoothedWeight: float = 0.2
    allowGoodTuring: bool = False
    allowKN: bool = False
    allowMKN: bool = False
    allowSmoothing: bool = False
    withSyntaxInfo: bool = False
    depType: Dependencies = Dependencies.DepString
    posType: Tags = Tags.AllPossible
    constrainedType: Constraint = Constraint.WellFormed
    syntax: Syntax = Syntax.S2D
    keepFloatingPOS: bool = False

    def limits(self) -> dict:
        """The limits of the mode: those of phrases, or those of rules."""
        if self.optType is Extract.Phrase:
            return {"max_c": self.maxc, "max_e": self.maxe, "extend": self.allowBoundaryUnaligned}
        return {"max_span": self.maxSpan, "max_slots": self.maxSlots, "max_symbols": min(self.maxCSymbols, self.maxESymbols), "min_words": max(self.minCWords, self.minEWords), "consecutive": self.allowConsecutive, "all_unaligned": self.allowAllUnaligned}

    def smoothing(self) -> str:
        """Which scores the table has: kn, mkn, gt or none, in this order."""
        if not self.allowSmoothing:
            return "none"
        return "mkn" if self.allowMKN else "kn" if self.allowKN else "gt" if self.allowGoodTuring else "none"


@dataclass
class Alignment:
    source: str = ""
    target: str = ""
    alignedRoot: str = ""
    redo: bool = True
    iterations: int = 1
    numCls: int = 50
    maxSentLen: int = 100
    totalReducer: int = 10
    splitNum: int = 1
    trainSeq: str = "1*H*"
    symalmethod: str = "grow-diag-final-and"
    overwrite: bool = True
    encoding: str = "UTF-8"


@dataclass
class LanguageModel:
    lmRootDir: str = ""
    lmInputFileName: str = ""
    N: int = 5
    splitDataRation: float = 0.01
    sampleNum: int = 10
    expectedErrorRate: float = 0.01
    offset: int = 100
    GT: bool = False
    GSB: bool = True
    KN: bool = False
    MKN: bool = False

    def kinds(self) -> list[str]:
        return [k.lower() for k in ("GT", "GSB", "KN", "MKN") if getattr(self, k)]


@dataclass
class Settings:
    mt: Translation = field(default_factory=Translation)
    wam: Alignment = field(default_factory=Alignment)
    lm: LanguageModel = field(default_factory=LanguageModel)
    sparkPara: dict = field(default_factory=dict)

    def shown(self) -> str:
        """All settings as lines, sections in order."""
        value = lambda v: v.name if isinstance(v, enum.Enum) else v
        return "\n".join(f"{s}.{k} = {value(v)}" for s in ("mt", "wam", "lm") for k, v in vars(getattr(self, s)).items())


_token = re.compile(r'\s*(?:(//|#)[^\n]*|("(?:[^"\\]|\\.)*")|([{}])|(\n)|([=:])|(,)|(\$\{[^}]*\})|([^\s{}=:,"#]+(?:[ \t]+[^\s{}=:,"#]+)*))')


def _tree(text: str) -> dict:
    """Nested sections of ``key = value`` and ``key { ... }`` with comments, quoted texts and ${References}; a key with dots is a path."""
    root: dict = {}
    stack, key, at, wants = [root], None, 0, False

    def put(k: str, v) -> dict:
        node = stack[-1]
        *path, last = k.split(".")
        for p in path:
            node = node.setdefault(p, {})
        if isinstance(v, dict):
            v = {**node.get(last, {}), **v} if isinstance(node.get(last), dict) else v
        node[last] = v
        return v

    while at < len(text):
        m = _token.match(text, at)
        if not m:
            if text[at:].strip():
                raise ValueError(f"not understood: {text[at : at + 40]!r}")
            break
        at = m.end()
        comment, quoted, brace, _, sign, _, ref, word = m.groups()
        if comment:
            continue
        if brace == "{":
            stack.append(put(key, {}))
            key, wants = None, False
        elif brace == "}":
            if len(stack) == 1:
                raise ValueError("a brace closes nothing")
            stack.pop()
        elif sign:
            wants = True
        elif quoted or ref or word:
            value = json.loads(quoted) if quoted else ref[2:-1].rsplit(".", 1)[-1] if ref else word
            if wants and key is not None:
                put(key, value)
                key, wants = None, False
            else:
                key = value
    if len(stack) > 1:
        raise ValueError("a section isn't closed")
    return root


def _typed(cls, values: dict):
    out = {}
    for f in dataclasses.fields(cls):
        if f.name not in values:
            continue
        v, kind = values[f.name], type(f.default)
        if isinstance(f.default, enum.Enum):
            names = {x.name.lower(): x for x in kind} | {str(x.value).lower(): x for x in kind}
            if str(v).lower() not in names:
                raise ValueError(f"{f.name}: no mode {v}")
            v = names[str(v).lower()]
        elif kind is bool:
            if str(v).lower() not in ("true", "false", "yes", "no", "on", "off"):
                raise ValueError(f"{f.name}: {v} is neither true nor false")
            v = str(v).lower() in ("true", "yes", "on")
        else:
            v = kind(v)
        out[f.name] = v
    return cls(**out)


def loaded(text: str) -> Settings:
    """Settings of a configuration text; what it doesn't name has its default, keys that nothing reads are passed over."""
    t = _tree(text)
    return Settings(_typed(Translation, t.get("mt", {})), _typed(Alignment, t.get("wam", {})), _typed(LanguageModel, t.get("lm", {})), t.get("sparkPara", {}))
