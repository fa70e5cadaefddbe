"""Runnable jobs: python -m jobs.<name> --config jobs/<name>.json, with any setting overridden by --<setting>."""
