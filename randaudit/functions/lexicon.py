"""Fixed values of the source scan: tokens, contexts and expressions that reveal weak entropy."""

from __future__ import annotations

CWE = "CWE-330"

#: Fixed values: (pattern, type, base risk, description), in scan order.
LEXICON = [
    ("block.timestamp", "timestamp", 0.7, "Timestamp can be manipulated by miners"),
    ("block.difficulty", "difficulty", 0.8, "Difficulty is predictable and manipulatable"),
    ("block.number", "blocknumber", 0.6, "Block number is predictable"),
    ("block.gaslimit", "gaslimit", 0.5, "Gas limit can be influenced"),
    ("block.coinbase", "coinbase", 0.5, "Miner address is known"),
    ("blockhash", "blockhash", 0.9, "Blockhash is manipulatable for recent blocks"),
    ("block.prevrandao", "prevrandao", 0.9, "PREVRANDAO is not suitable for gambling"),
    ("now", "timestamp", 0.7, "Alias for block.timestamp"),
]

#: Further sources that are documented but not scanned by default; (pattern, controller, level, misuse).
EXTENDED = [
    ("gasleft()", "User", "High", "Seed generation"),
    ("tx.gasprice", "User", "High", "Combined with block values"),
    ("tx.origin", "User", "High", "Lottery selection"),
    ("msg.sender", "User", "High", "Random seed component"),
]

#: Expressions that tell how a token is used, in the order that decides ties, and what a use does to the risk.
CONTEXTS = {
    "gambling": [
        r"%\s*players\.length",
        r"%\s*\d+\s*==\s*0",
        r"random|lottery|bet|gambl|winner|prize|jackpot",
        r"keccak256.*block\.(timestamp|difficulty)",
        r"abi\.encode.*block\.(timestamp|difficulty)",
        r"winner\s*=.*%",
        r"uint.*rand.*=",
        r"shuffle|draw|pick",
    ],
    "timing": [
        r"require\s*\(.*block\.timestamp\s*[<>]=?",
        r"if\s*\(.*block\.timestamp\s*[<>]=?",
        r"endTime|startTime|deadline|duration",
        r"block\.timestamp\s*\+\s*\d+",
        r"timelock|vesting|cliff",
        r">\s*=\s*endTime",
        r"<\s*startTime",
    ],
    "randomness": [
        r"keccak256\s*\([^)]*block\.",
        r"sha256\s*\([^)]*block\.",
        r"abi\.encodePacked\s*\([^)]*block\.",
        r"uint.*=.*block\..*%",
        r"seed\s*=.*block\.",
        r"nonce.*block\.",
        r"random.*=.*keccak",
    ],
    "access_control": [
        r"require\s*\(\s*msg\.sender\s*==",
        r"onlyOwner|onlyAdmin|authorized",
        r"modifier\s+\w+\s*\(",
        r"mapping.*address.*bool",
    ],
}
MULTIPLIERS = {"gambling": 1.3, "timing": 0.5, "randomness": 1.5, "access_control": 0.3}

#: Text before a token that shows it stands inside an expression.
NESTED = [
    r"keccak256\s*\([^)]*$",
    r"abi\.encode\w*\s*\([^)]*$",
    r"uint\d*\s*\([^)]*$",
    r"\([^)]*\+[^)]*$",
    r"\([^)]*\*[^)]*$",
    r"\([^)]*-[^)]*$",
    r"\([^)]*%[^)]*$",
]

#: Expressions that combine sources.
COMBINED = [
    r"keccak256\s*\([^)]*block\.\w+[^)]*block\.\w+[^)]*\)",
    r"block\.\w+\s*[\+\-\*]\s*block\.\w+",
    r"keccak256\s*\([^)]*msg\.sender[^)]*block\.\w+[^)]*\)",
    r"abi\.encode\w*\s*\([^)]*block\.\w+[^)]*block\.\w+[^)]*\)",
]

#: State variables with an initial value, functions and constructors.
STATE_VARIABLE = r"^\s*(uint\d*|int\d*|address|bytes\d*)\s+(?:private|public|internal)?\s*(\w+)\s*=\s*([^;]+);"
FUNCTION = (
    r"function\s+(\w+)\s*\([^)]*\)\s*(?:public|private|internal|external|view|pure|payable|\s)*\s*(?:returns\s*\([^)]*\))?"
    r"\s*\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"
)
CONSTRUCTOR = r"constructor\s*\([^)]*\)\s*(?:public|payable|\s)*\s*\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"

#: Risk factors of a use.
FACTORS = {
    "gambling": ["gambling_context", "high_stakes", "manipulation_incentive"],
    "randomness": ["randomness_generation", "predictable_source"],
    "timing": ["time_dependency", "miner_influence"],
    "access_control": ["access_check", "low_risk"],
}


def token_regex(pattern: str) -> str:
    """The token with word bounds; a token that ends in a bracket has no bound there."""
    escaped = "".join("\\" + c if c in ".()" else c for c in pattern)
    return rf"\b{escaped}" + (r"\b" if pattern[-1].isalnum() else "")
