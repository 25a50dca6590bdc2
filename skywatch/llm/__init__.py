"""Training-data operators: language identification, near-duplicate and
decontamination joins, extraction, archives, chat formatting, mixing and
language-model scoring. Nothing else in the library imports this package."""
