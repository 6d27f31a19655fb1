"""faultlens.functions"""
