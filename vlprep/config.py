"""Fixed values and presets shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

# They must equal what trainers of this data expect.
IGNORE_LABEL = -100
PAD_ID = 0
LENGTH_LOW = 1          # exclusive
LENGTH_HIGH = 128       # exclusive
TEMPERATURE_INIT = 0.07
SCALER_MAX = 100.0
QUERY_POSITIONS = 196
MAX_PAIRS = 3
VALIDATION_ROWS = 1000
TEST_DIVISOR = 10
SHUFFLE_BUFFER = 1000
MAX_NEW_TOKENS = 100
IMAGE_SIZE = 224
PATCH_SIZE = 16
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)
SEED = 1337

SYSTEM_PROMPT = "You are a helpful assistant."
CLASS_TEMPLATE = "a photo of a %s"
MESSAGE_START = "<|im_start|>"
MESSAGE_END = "<|im_end|>"

# Word pattern of the default tokeniser. The match is on whole texts.
WORD_PATTERN = r"\S+"

# A table is broadcast only when its row count is proven to stay below this.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class LabelRule:
    """Which positions of a padded row are excluded from the loss."""

    mask_prompt: bool
    mask_pad: bool


PRETRAIN = LabelRule(mask_prompt=True, mask_pad=False)
FINETUNE = LabelRule(mask_prompt=False, mask_pad=True)
STRICT = LabelRule(mask_prompt=True, mask_pad=True)


@dataclass(frozen=True)
class SplitPaths:
    """Where the training and the validation shards of a corpus lie."""

    train: str
    val: str

    def path(self, split: str) -> str:
        if split not in ("train", "val"):
            raise ValueError(f"split must be 'train' or 'val', got {split!r}")
        return self.train if split == "train" else self.val
