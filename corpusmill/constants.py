"""Fixed values shared by every stage."""

# Ids of the special pieces.
PAD_ID = 0
UNK_ID = 1
BOS_ID = 2
EOS_ID = 3
SPECIAL_PIECES = {"<pad>": PAD_ID, "<unk>": UNK_ID, "<bos>": BOS_ID, "<eos>": EOS_ID}

# Byte pieces follow the specials, so byte b has id FIRST_BYTE_ID + b.
FIRST_BYTE_ID = len(SPECIAL_PIECES)
FIRST_MERGE_ID = FIRST_BYTE_ID + 256
BYTE_VOCAB_SIZE = FIRST_MERGE_ID

# Shards are headerless little-endian unsigned 16-bit integers.
SHARD_DTYPE = "uint16"
MAX_TOKEN_ID = 65_535

# Defaults of the dataset build.
MIN_WORDS = 32
VAL_EVERY = 200
SHARD_SIZE = 100_000_000
VOCAB_SIZE = 32_768
MIN_VOCAB_SIZE = 300
CHARACTER_COVERAGE = 0.9995
MAX_PIECE_CHARS = 16

# Defaults of the training and generation plans.
CONTEXT_LENGTH = 2_048
SEED = 42
EPOCH_SEED_STRIDE = 1_000_003
MAX_LOSS_FOR_EXP = 80.0

# The visible word-boundary mark used inside pieces.
SPACE_MARK = "▁"
