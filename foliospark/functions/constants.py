"""Semantic parameters and word lists of the retrieval engine."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# Function words of Indonesian and English that carry no meaning
# for retrieval.  Results depend on exactly these lists.
FUNCTION_WORDS = """
ada adalah adanya agar akan aku akhir akhirnya antar antara apa apabila apakah
atas atau ataupun bagaimana bagi bahkan bahwa banyak baru begitu belum benar
berada berapa berikut bersama beserta bila bisa boleh buat bukan cukup dahulu
dalam dan dapat dari daripada dekat demi dengan di dia dll dsb dua entah guna
hal hampir hanya harus hendak hingga ia ialah ini itu jadi jangan jika juga
kalau kami kamu kapan karena ke kecuali kemudian kepada kita ku lagi lain
lalu maka makin mana manakala masih maupun melainkan melalui memang mempunyai
mengapa mengenai menjadi menurut mereka merupakan meski meskipun mungkin nah
namun nya oleh pada padahal paling para pasti per pernah pula pun punya saat
saja sama sambil sampai sana sangat saya se sebab sebagai sebagaimana sebelum
sebuah secara sedang sedangkan segera sehingga sejak sekali sekitar selain
selama seluruh semua sendiri seorang seperti sering serta sesuai sesudah
setelah setiap siapa sini situ suatu sudah supaya tadi tak tanpa tapi telah
tentang tentu terhadap termasuk tersebut tetap tetapi tiap tidak turut untuk
walau walaupun yaitu yakni yang
a an and are as at be but by for from has have how in is it its of on or that
the this to was were what when where which who will with
"""
STOPWORDS = tuple(dict.fromkeys(FUNCTION_WORDS.split()))

# Phrases joined to one token, in the order of replacement.
PHRASE_ALIASES = (
    ("mata kuliah", "matakuliah"),
    ("tugas akhir", "tugasakhir"),
    ("kerja praktek", "kerjapraktek"),
    ("kerja praktik", "kerjapraktek"),
    ("kartu rencana studi", "krs"),
    ("kartu hasil studi", "khs"),
    ("indeks prestasi kumulatif", "ipk"),
    ("indeks prestasi", "ip"),
    ("satuan kredit semester", "sks"),
    ("cum laude", "cumlaude"),
    ("uang kuliah tunggal", "ukt"),
    ("program studi", "programstudi"),
    ("semester antara", "semesterantara"),
    ("semester pendek", "semesterantara"),
    ("ujian tengah semester", "uts"),
    ("ujian akhir semester", "uas"),
    ("drop out", "dropout"),
)

# Single tokens and their canonical form.
TOKEN_ALIASES = {
    "matkul": "matakuliah",
    "mk": "matakuliah",
    "ta": "tugasakhir",
    "skripsi": "tugasakhir",
    "kp": "kerjapraktek",
    "prodi": "programstudi",
    "jurusan": "programstudi",
    "mhs": "mahasiswa",
    "univ": "universitas",
    "do": "dropout",
}

# Clitics, first match wins, and what must remain of a word.
CLITICS = ("nya", "lah", "kah", "pun", "ku", "mu")
CLITIC_STEM = 4


def roman(n: int) -> str:
    """Lower-case Roman numeral of 1 to 39."""
    return "x" * (n // 10) + ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")[n % 10]


ROMAN_NUMERALS = tuple(roman(n) for n in range(1, 31))

# Consonant clusters that count as one, three letters first.
CONSONANT_CLUSTERS = ("str", "spr", "skr", "ng", "ny", "sy", "kh", "th", "ch", "tr", "dr", "kr", "gr", "br", "pr", "kl", "gl", "bl", "pl", "fl", "st", "sp", "sk", "sl", "sm", "sn")

# Line filters
MIN_ALNUM = 3
GIBBERISH_RATIO, GIBBERISH_WORDS, GIBBERISH_WORD_LENGTH, CONSONANT_RUN = 0.5, 3, 4, 3
TEMPLATE_RATIO, TEMPLATE_PAGES, TEMPLATE_LENGTH = 0.10, 5, 90
NOISY_LINES, NOISY_SHARE = 20, 0.5

# Chunking
CHUNK_SIZE, CHUNK_OVERLAP, MIN_CHUNK, MAX_PAGES = 1400, 250, 120, 3
SMALL_MERGE, NOISE_STOPWORDS, NOISE_DIGITS = 0.4, 0.02, 0.08
CAPS_LETTERS, HEADING_LENGTH = 6, 120
SHORT_LINE_DEFAULT, SHORT_LINE_SHARE, SHORT_LINE_OVER = 40.0, 0.6, 20

# Lexical scoring
BM25_K1, BM25_B = 1.5, 0.75

# Reranking and judging
RERANK_SNIPPET, JUDGE_CONTEXT, JUDGE_PASS = 900, 1400, 7.0
HISTORY_MESSAGES, HISTORY_CHARS = 6, 400
REWRITE_WORDS, REWRITE_FLOOR, REWRITE_FACTOR = 4, 240, 6

# Citations
CITATION_SPAN = 40

# Rate limit
RATE_LIMIT, RATE_WINDOW = 20, 3600
PIPELINE_VERSION = 3


@dataclass(frozen=True)
class RetrievalConfig:
    """Parameters of one retrieval run."""

    top_k: int = 4
    dense_candidates: int = 20
    lexical_candidates: int = 20
    fusion_candidates: int = 10
    rrf_k: int = 60
    dense_weight: float = 1.0
    lexical_weight: float = 1.0
    dense_threshold: float = 0.70
    lexical_coverage_threshold: float = 0.60
    rescue_dense_ratio: float = 0.7
    rescue_min_terms: int = 2
    rerank_min_score: float = 4.0
    use_hybrid: bool = True
    use_rerank: bool = True
    use_query_rewrite: bool = True
    document_filter: tuple[str, ...] = ()

    def with_overrides(self, **changes) -> RetrievalConfig:
        """A copy; ``None`` values are ignored, unknown names are an error."""
        known = {f.name for f in fields(self)}
        if unknown := sorted(set(changes) - known):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


PRESETS = {
    "dense": RetrievalConfig(use_hybrid=False, use_rerank=False, use_query_rewrite=False),
    "hybrid": RetrievalConfig(use_rerank=False, use_query_rewrite=False),
    "hybrid_rerank": RetrievalConfig(use_query_rewrite=False),
}
