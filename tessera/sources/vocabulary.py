"""Fixed values of the linkage rules: spellings, terms and patterns that results depend on."""

from __future__ import annotations


ARTIST_ALIASES = {
    "久石譲": ["Joe Hisaishi"],
    "山下達郎": ["Tatsuro Yamashita"],
    "竹内まりや": ["Mariya Takeuchi"],
    "清塚信也": ["Shinya Kiyozuka"],
    "NAOTO": ["Naoto"],
    "CAGNET": ["Cagnet"],
    "藤井風": ["Fujii Kaze"],
    "吉田美奈子": ["Minako Yoshida"],
    "ブレッド&バター": ["Bread And Butter"],
    "林ゆうき": ["Yuki Hayashi"],
    "宇多田ヒカル": ["Hikaru Utada"],
    "ラ・ムー": ["RA MU"],
    "村田和人": ["Kazuhito Murata"],
    "中原めいこ": ["Meiko Nakahara"],
    "松下誠": ["Makoto Matsushita"],
    "福原美穂": ["Miho Fukuhara"],
    "Olver Cheatham": ["Oliver Cheatham"],
}
#: By key: the spelling to search for, and the keys that count as this artist only with a close duration.
ARTIST_QUERY_SPELLINGS = {"olvercheatham": "Oliver Cheatham"}
DURATION_BOUND_SPELLINGS = {"olvercheatham": ["olivercheatham"]}
TITLE_ALIASES = {
    "マイ・ベイビー・クイーン": ["My Baby Queen"],
    "トゥルー・トゥ・ユア・ハート(キャグネット)": ["True to Your Heart", "True to Your Heart (From Mulan)"],
    "Just My Imagination": ["Just My Imagination (Running Away with Me)"],
}
TITLE_QUERY_SPELLINGS = {"coc*ine diana": "Cocaine Diana"}
SAFE_TERMS = ["remaster", "remastered", "reissue", "rerelease", "deluxeedition", "expandededition", "anniversaryedition", "specialedition"]
HARD_TERMS = ["live", "remix", "remixed", "acoustic", "instrumental", "demo", "radioedit", "extendedmix", "djversion", "djmixed", "speedup", "slowed"]
INVALID_TERMS = ["tribute", "cover", "karaoke"]
#: What a term looks like in a folded text; a term that isn't here looks like itself.
TERM_PATTERNS = {
    "remaster": r"remaster(?:ed)?",
    "remastered": r"remaster(?:ed)?",
    "rerelease": r"re[\s_-]*release",
    "deluxeedition": r"deluxe[\s_-]*edition",
    "expandededition": r"expanded[\s_-]*edition",
    "anniversaryedition": r"anniversary[\s_-]*edition",
    "specialedition": r"special[\s_-]*edition",
    "remix": r"remix(?:ed|es)?",
    "remixed": r"remix(?:ed|es)?",
    "radioedit": r"radio[\s_-]*edit",
    "extendedmix": r"extended[\s_-]*mix",
    "djversion": r"dj[\s_-]*version",
    "djmixed": r"dj[\s_-]*mixed",
    "speedup": r"speed[\s_-]*up",
    "tribute": r"tributes?",
    "cover": r"covers?",
}
ALL_TERMS = [*SAFE_TERMS, *HARD_TERMS, *INVALID_TERMS]
