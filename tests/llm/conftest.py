import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def tokenizer_path():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def tokenizer(tokenizer_path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path)


@pytest.fixture
def documents(spark):
    """Builds documents (doc_id, text, ...) with columns that clash with the operators' own names."""
    def build(texts, ids=None, **extra):
        rows = [(i, t, "src0", 1, "x", True, 7) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, source string, n int, digest string, kept boolean, value int")

    return build
