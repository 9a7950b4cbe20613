"""Part of chargeaudit; see README.md."""
