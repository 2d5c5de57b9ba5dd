"""Values that must stay exactly as they are for results to agree. Nothing here is logic."""

# Fixed value: the shipped cleaning list, one pattern per entry, in file order.
OCR_PATTERNS = (
    "[a-z]",
    "[\ue003-\ue7a4]",
    "□",
    "■",
    "[①-⑳]",
    "[⑴-⒇]",
    "[㈠-㈩]",
    "[⒈-⒓]",
    r"\*",
    r"\{",
    r"\}",
    "§",
    "︴",
    "-",
    "—",
    "_",
    "【",
    "】",
    "○",
    "\ufffd",
)

# Fixed value: the second shipped list.
EXTRA_PATTERNS = ("※",)

# Fixed value: turned into a line break after cleaning.
FULLWIDTH_SEMICOLON = "；"

# Chat and instruction templates.
DIALOGUE_INSTRUCTION = "下面是人类之间的对话与交流"
EQUATION_LABEL = "根据方程式"
ANSWER_LABEL = "解得:"
SYSTEM_PROMPT = "You are a helpful assistant. 你是一个乐于助人的助手。你拥有非常丰富的知识。"
PROMPT_HEAD = "[INST] <<SYS>>\n" + SYSTEM_PROMPT + "\n<</SYS>>\n\n"
PROMPT_TAIL = " [/INST]"

# Special tokens, their ids, the word mark and the ignored label.
UNK, BOS, EOS = "<unk>", "<s>", "</s>"
UNK_ID, BOS_ID, EOS_ID = 0, 1, 2
SPECIALS = (UNK, BOS, EOS)
WORD_MARK = "▁"
IGNORE_LABEL = -100

# Default sizes.
VOCAB_SIZE = 32_000
CHARACTER_COVERAGE = 0.9995
DEFAULT_BLOCK = 1024
BATCH_ROWS = 80_000
TEST_SHARE = 0.1
REPLICAS = 8
HEAD_LINES = 200

# Fixed value: the characters Java's \s matches; words are the runs between them.
WHITESPACE = " \t\n\x0b\f\r"
