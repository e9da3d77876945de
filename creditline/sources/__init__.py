from creditline.sources.adapter import MarketingInputs, marketing_inputs  # noqa: F401
