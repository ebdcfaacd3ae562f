from tidemark.functions import paths, scores, text  # noqa: F401
