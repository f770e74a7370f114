"""Plans of questions, packs, model calls."""
