"""What several tests of the analyses share."""

PROPERTIES = ["plan", "country"]
