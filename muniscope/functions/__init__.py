"""Part of muniscope."""
