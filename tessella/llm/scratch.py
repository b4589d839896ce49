from ..scratch import discard, materialize, materialize_alone, shared_dir

__all__ = ["discard", "materialize", "materialize_alone", "shared_dir"]
