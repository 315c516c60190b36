"""Part of planscope."""
