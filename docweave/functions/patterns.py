"""Patterns, concept keywords and evaluation cases.

Java spellings: (?d) makes only a line feed end a line, (?U) makes classes
Unicode-aware, (?iu) ignores case beyond ASCII.
"""

from __future__ import annotations

# Heading, citation and structure patterns.
CHAPTER = r"(?dUium)^CHAPTER\s+(\d+)[:\-]?\s*(.+)$"
SECTION = r"(?dUium)^(?:Section|§)\s*([\d.]+)[:\-]?\s*(.+)$"
SUBSECTION = r"(?dUm)^\s*\(([a-z]|\d+)\)\s*(.+)$"
STATUTE = r"(?Uiu)(?:M\.?G\.?L\.?|General Laws?)\s*c(?:hapter|\.)?\s*(\d+)[,\s]*(?:§|s(?:ection|\.))\s*([\d\.]+)"
# A party may take in every unpunctuated word before it. A match is only tried
# where such a run begins, which finds the same matches in linear time.
CASE = r"(?dUiu)(?:\G|(?<![\w\s]))\s*(\w(?:[\w\s]*\w)?)\s+v\.\s+(\w(?:[\w\s]*\w)?),\s*(\d+)\s+Mass\.\s*(\d+)(?:\s*\((\d{4})\))?"
DEFINITION = r'(?Uiu)"([^"]+)"\s+(?:means?|is defined as)'
ELEMENTS = r"(?dUiu)(?:elements?|requirements?|conditions?).*?(?:are|include)?:?\s*$"
NUMBERED = r"(?dUm)^\s*(\d+)\.?\s+(.+)$"
SPLIT_CHAPTER = r"\n(?=CHAPTER\s+\d+)"
SPLIT_SECTION = r"\n(?=Section\s+[\d.]+)"

# Cleaning rules, in order: pattern, replacement.
CLEANING = (
    (r"(?Uiu)Page\s+\d+\s*(of\s+\d+)?", ""),
    (r"(?dUm)^\s*\d+\s*$", ""),
    (r"(?dUm)^\s*[-–—]\s*\d+\s*[-–—]\s*$", ""),
    (r"(?Uiu)Massachusetts\s+Criminal\s+Law\s+\d{4}", ""),
    (r"(?dUm)^\s*Chapter\s+[IVXLCDM]+\s*$", ""),
    (r"\n{3,}", "\n\n"),
    (r"[ \t]+", " "),
    (r"[|]{2,}", ""),
    (r"[-]{4,}", ""),
)

# Concepts and their keywords.
CONCEPTS = {
    "miranda_rights": ["Miranda", "right to remain silent", "right to counsel", "waiver"],
    "probable_cause": ["probable cause", "PC", "reasonable grounds", "reasonable belief"],
    "search_warrant": ["warrant", "search authorization", "judicial approval", "magistrate"],
    "automobile_exception": ["automobile exception", "motor vehicle exception", "Carroll doctrine"],
    "terry_stop": ["Terry stop", "investigatory stop", "reasonable suspicion", "frisk"],
    "use_of_force": ["use of force", "deadly force", "reasonable force", "excessive force"],
    "arrest": ["arrest", "custodial arrest", "arrest warrant", "warrantless arrest"],
    "oui_dui": ["OUI", "DUI", "operating under influence", "drunk driving"],
    "consent_search": ["consent", "voluntary consent", "consent to search"],
    "exigent_circumstances": ["exigent circumstances", "emergency", "hot pursuit", "immediate danger"],
}

# Evaluation cases (query, concepts, citations, terms, difficulty).
EVAL_CASES = [
    ("What are the elements of OUI in Massachusetts?", ["oui_dui"], ["M.G.L. c. 90"], ["operate", "under influence", "public way"], "basic"),
    ("When can police conduct a protective sweep?", ["search_warrant", "exigent_circumstances"], ["Maryland v. Buie"], ["articulable facts", "armed", "dangerous"], "intermediate"),
    ("What constitutes a valid Miranda waiver?", ["miranda_rights"], None, ["knowing", "intelligent", "voluntary"], "intermediate"),
    ("Explain the automobile exception to warrant requirement", ["automobile_exception", "search_warrant", "probable_cause"], None, ["mobility", "exigent", "Carroll"], "advanced"),
    ("What are the requirements for a Terry stop?", ["terry_stop"], None, ["reasonable suspicion", "articulable facts"], "basic"),
]

# Thresholds below which a report recommends an action.
MIN_QUALITY, MIN_CITATIONS, MIN_CONCEPTS = 0.6, 0.3, 0.5
EXIT_WORDS = ("quit", "exit", "q")
